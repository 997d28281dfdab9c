"""Line dedup: range-partitioned line hashes, streamed in order, answered by keep bitmaps.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased; 128 bits of it
stand for it. Hashes are range-partitioned on (hash, document) and sorted by (hash, document, position)
inside a partition, so a very common line spreads over as many partitions as its rows need. One pass
streams each partition: it sees the first occurrence of a line in every document in order, and passes on only
the lines found in enough documents. Texts never take part in that shuffle, and what comes out are
compressed bitmaps of the lines that each document keeps.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import arrow, utf8_bodies

#: A line found in this many documents goes, and only keys of this many code points count.
MIN_DOCS, MIN_CHARS = 10, 1

#: Documents whose texts a task holds at a time beside its batch.
ROWS = 512


def line_key(line: bytes) -> bytes:
    """The key of a line. ``bytes.strip`` and ``bytes.lower`` know ASCII only, as the rule does."""
    return line.strip().lower()


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _identity(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, text): a text's hash beside the id tells rows apart that repeat an id."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))


def _line_hashes(min_chars: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, rows, counts, places = [], [], [], []
            for r, body in enumerate(utf8_bodies(b.column("text"))):
                lines, at = body.split(b"\n"), {}
                for i, line in enumerate(lines):
                    key = line_key(line)
                    if key and (min_chars <= 1 or _code_points(key) >= min_chars):
                        at.setdefault(xxhash.xxh128_digest(key), []).append(i)
                digests += at
                rows += [r] * len(at)
                counts += [len(lines)] * len(at)
                places += [np.array(p, "<i4").tobytes() for p in at.values()]
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            took = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), b.column("id").take(took), b.column("text_key").take(took), pa.array(counts, pa.int32()), pa.array(places, pa.binary())], names=["h1", "h2", "id", "text_key", "n_lines", "places"])

    return run


def _stream_common(min_docs: int) -> Callable:
    """Of a sorted partition, the rows of keys found in ``min_docs`` documents (``sure``), and those of the first and
    the last key where they fall short, as these may go on in a neighbouring partition. Holds one batch and
    less than ``min_docs`` documents of the key that is still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, open_key, first = None, None, True

        def out(t: pa.Table, keep: np.ndarray, sure: np.ndarray) -> Iterator[pa.RecordBatch]:
            got = t.filter(pa.array(keep)).append_column("sure", pa.array(sure[keep]))
            yield from got.combine_chunks().to_batches()

        for b in batches:
            t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b]).combine_chunks()
            if not t.num_rows:
                continue
            h1, h2 = (t.column(c).to_numpy() for c in ("h1", "h2"))
            doc = t.column("id").combine_chunks().dictionary_encode(null_encoding="encode")
            doc = (doc.chunk(0) if isinstance(doc, pa.ChunkedArray) else doc).indices.to_numpy()
            new_key = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            new_doc = new_key | np.r_[True, doc[1:] != doc[:-1]]
            starts = np.flatnonzero(new_key)
            sure = np.add.reduceat(new_doc.astype(np.int64), starts) >= min_docs
            sure[0] |= open_key == (h1[0], h2[0])
            edge = np.zeros(len(starts), bool)
            edge[0] = first
            first &= len(starts) == 1
            size = np.diff(np.r_[starts, t.num_rows])
            keep, last = np.repeat(sure | edge, size), starts[-1]
            if sure[-1]:
                open_key, rest = (h1[-1], h2[-1]), None
            else:
                open_key, rest, keep[last:] = None, t.slice(last), False
            yield from out(t, keep, np.repeat(sure, size))
        if rest is not None:
            n = rest.num_rows
            yield from out(rest, np.ones(n, bool), np.zeros(n, bool))

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keeps, dropped = [], []
        for n, parts in zip(b.column("n_lines").to_pylist(), b.column("places").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[np.frombuffer(b"".join(parts), "<i4")] = False
            keeps.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_key"), b.column("n_lines"), pa.array(dropped, pa.int32()), pa.array(keeps, pa.binary())], names=["id", "text_key", "n_lines", "n_dropped", "keep"])


def unpack(keep: bytes, n_lines: int) -> np.ndarray:
    """The booleans of a bitmap: True for the lines that stay."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, n_lines, n_dropped, keep) of every document that loses a line; ``keep`` is a zlib-compressed bitmap with
    a bit per line, ``text_key`` Spark's xxhash64 of the text.

    Rows that repeat an id count as one document, rows without an id too; a null text is one empty line; empty keys
    never count; an empty table gives an empty result."""
    kind = docs.schema[id_col].dataType.simpleString()
    lines = arrow(_identity(docs, id_col, text_col), _line_hashes(min_chars), f"h1 long, h2 long, id {kind}, text_key long, n_lines int, places binary")
    ordered = lines.repartitionByRange("h1", "h2", "id").sortWithinPartitions("h1", "h2", "id", "text_key")
    found = materialize(arrow(ordered, _stream_common(min_docs), lines.schema.add("sure", T.BooleanType())), "line-dedup")
    # keys that a partition's edge cuts: at most two a partition, counted over all their parts
    unsure = found.filter(~F.col("sure"))
    cut = found.join(unsure.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    common = cut.groupBy("h1", "h2").agg(F.count("one").alias("n")).filter(F.col("n") >= min_docs)
    gone = found.filter("sure").unionByName(unsure.join(common, ["h1", "h2"], "left_semi"))
    # a document's lines have places of their own, so those of a row that repeats are the same sets again
    per_doc = gone.groupBy("id", "text_key").agg(F.max("n_lines").alias("n_lines"), F.collect_set("places").alias("places"))
    return arrow(per_doc, _pack, f"id {kind}, text_key long, n_lines int, n_dropped int, keep binary")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept text, lines and dropped lines of each row; null text only where it was null and lost nothing."""
    for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
        texts, lines, dropped = [], [], []
        for text, body, keep in zip(b.column("text"), utf8_bodies(b.column("text")), b.column("keep"), strict=True):
            n = body.count(b"\n") + 1
            if not keep.is_valid:
                texts.append(body if text.is_valid else None)
                dropped.append(0)
            else:
                stays = unpack(keep.as_py(), n)
                texts.append(b"\n".join([x for x, k in zip(body.split(b"\n"), stays, strict=True) if k]))
                dropped.append(int(n - stays.sum()))
            lines.append(n)
        at = [i for i, c in enumerate(b.schema.names) if c not in ("text", "keep")]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in at), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*(b.schema.names[i] for i in at), "kept_text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept_text, n_lines, n_dropped, row) of every row of ``docs``: its text without the lines found in at least
    ``min_docs`` documents, and its other columns, whatever they are named, in the struct ``row``."""
    bitmaps = keep_bitmaps(docs, min_docs, min_chars, id_col, text_col)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    row = F.struct(*rest) if rest else F.struct(F.lit(1).alias("none"))
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"), row.alias("row"))
    b = bitmaps.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), "keep")
    joined = own.join(b, own["id"].eqNullSafe(b["_id"]) & (own["text_key"] == b["_key"]), "left").select("id", "row", "text", "keep")
    return arrow(joined, _applied, T.StructType([joined.schema["id"], joined.schema["row"], T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))
