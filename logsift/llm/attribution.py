"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole. Every token has a span of characters in it (a token that holds a part of a
character spans the whole character), and so has every section or field. Joining the two sorted lists of spans
gives each token to one section, by an explicit rule where a token lies across a boundary.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, utf8_bodies

#: To whom a token across a boundary goes: the section with its first character, with its last one, or with most of its
#: characters (the first of several).
RULES = ("first", "last", "largest")

#: White space runs of this length are cut out beforehand: the library's pattern engine overflows on longer ones.
_LONG_SPACE = regex.compile(r"\s{20000,}")


class RankEncoder:
    """A byte-level BPE vocabulary of ranks, with the length in bytes of every token."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self._bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self._split = regex.compile(pattern)
        self.length = np.zeros(max(merges.values()) + 1, np.int64)
        for token, i in merges.items():
            self.length[i] = len(token)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; strings of special tokens are ordinary text. The library splits all of it but the pieces that lie in a long
        run of white space, which the pattern is applied to here; the text behind them is the library's again."""
        out, at = [], 0
        for run in _LONG_SPACE.finditer(text):
            if run.end() <= at:
                continue
            out += self._bpe.encode_ordinary(text[at : run.start()])
            at = run.start()
            while at < run.end() and (piece := self._split.match(text, at)) and piece.end() <= run.end():
                out += self._bpe._encode_single_piece(piece[0])
                at = piece.end()
        return out + self._bpe.encode_ordinary(text[at:])

    def spans(self, body: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of every token, in characters of the text."""
        ids = np.array(self.encode(body.decode()), np.int64)
        ends = np.cumsum(self.length[ids]) if len(ids) else ids
        starts = ends - self.length[ids] if len(ids) else ids
        if body.isascii():
            return starts, ends
        # the number of characters that begin at or before each byte
        begun = np.cumsum((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)
        return begun[starts] - 1, begun[ends - 1]


def attribute(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """For each section [first, last) the number of tokens given to it, and how many of them cross its boundary. Tokens and
    sections are sorted and sections do not overlap; a token without a character in any section goes to none, and one
    whose first (last) character is in none goes, by that rule, to the first (last) section that it reaches."""
    got, crossing = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    full = np.flatnonzero(last > first)  # an empty section holds no character
    if not len(full) or not len(starts):
        return got, crossing
    first, last = first[full], last[full]
    low = np.searchsorted(last, starts, "right")  # first section that ends behind the token's start
    high = np.searchsorted(first, ends, "left") - 1  # last section that begins before its end
    inside = np.flatnonzero(low <= high)
    low, high, s, e = low[inside], high[inside], starts[inside], ends[inside]
    to = low.copy()
    if rule == "last":
        to = high.copy()
    elif rule == "largest":
        for i in np.flatnonzero(low != high):  # few tokens reach two sections
            k = np.arange(low[i], high[i] + 1)
            to[i] = k[np.argmax(np.minimum(last[k], e[i]) - np.maximum(first[k], s[i]))]
    across = (s < first[to]) | (e > last[to])
    got[full] = np.bincount(to, minlength=len(full))
    crossing[full] = np.bincount(to[across], minlength=len(full))
    return got, crossing


def line_sections(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lines as sections: each from its first character to behind its newline, so that they cover the text. An empty text
    is one empty section."""
    raw = np.frombuffer(body, np.uint8)
    begins = (raw & 0xC0) != 0x80
    chars = np.cumsum(begins)
    breaks = chars[raw == 10] if len(raw) else np.zeros(0, np.int64)
    return np.r_[0, breaks], np.r_[breaks, chars[-1] if len(raw) else 0]


def load_ranks(spark: SparkSession, path: str):
    """A file of ranks as a broadcast; workers need no copy of it. One over 64 MB is refused."""
    with open(path, "rb") as f:
        ranks = f.read((64 << 20) + 1)
    if len(ranks) > 64 << 20:
        raise ValueError(f"{path} is larger than a vocabulary can be")
    return spark.sparkContext.broadcast(ranks)


_ENCODERS: dict[int, RankEncoder] = {}


def _encoder(ranks, pattern: str) -> RankEncoder:
    key = hash((ranks.value, pattern))
    if key not in _ENCODERS:
        _ENCODERS[key] = RankEncoder(ranks.value, pattern)
    return _ENCODERS[key]


_OUT = "section int, start_char long, end_char long, n_tokens long, n_crossing long"


def _counts(ranks, pattern: str, rule: str, given: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks, pattern)
        for b in batches:
            rows, cols, held = [], [[], [], [], [], []], 0
            own = b.column("sections") if given else None
            for r, body in enumerate(utf8_bodies(b.column("text"))):
                if given:
                    spans = sorted((x["start"], x["end"]) for x in own[r].as_py() or [])
                    first, last = (np.array(x, np.int64) for x in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64),) * 2
                else:
                    first, last = line_sections(body)
                got, crossing = attribute(*encoder.spans(body), first, last, rule)
                rows.append(np.full(len(first), r))
                for c, x in zip(cols, (np.arange(len(first)), first, last, got, crossing), strict=True):
                    c.append(x)
                held += len(first)
                if held >= 1 << 16:  # a text can have any number of sections
                    yield _batch(b, rows, cols)
                    rows, cols, held = [], [[], [], [], [], []], 0
            yield _batch(b, rows, cols)

    return run


def _batch(b: pa.RecordBatch, rows: list, cols: list) -> pa.RecordBatch:
    took = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    whole = [np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64) for c in cols]
    return pa.RecordBatch.from_arrays([b.column("id").take(pa.array(took)), pa.array(whole[0].astype(np.int32)), *(pa.array(c) for c in whole[1:])], names=["id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])


def token_counts(docs: DataFrame, path: str, pattern: str, rule: str = "largest", sections_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, start_char, end_char, n_tokens, n_crossing) of every section of every row: the tokens given to it, and
    those of them that reach beyond it.

    Sections are the lines, each with its newline; or with ``sections_col`` the structs (start, end) in that array column,
    in characters, not overlapping, numbered in their order. Counts of sections that cover a text add up to
    its tokens. Null and empty texts have one empty line and no tokens; no given sections, no rows; repeated
    rows give their rows again; other columns are ignored."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema[id_col].dataType.simpleString()
    sections = [F.col(sections_col).cast("array<struct<start:bigint,end:bigint>>").alias("sections")] if sections_col else []
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *sections)
    return arrow(rows, _counts(load_ranks(docs.sparkSession, path), pattern, rule, bool(sections_col)), f"id {kind}, {_OUT}")


def joined_fields(rows: DataFrame, fields: list[str], separator: str = "\n", text: str = "text", sections: str = "sections") -> DataFrame:
    """Fields of each row (null: empty) as one text, with each field's span: what ``token_counts`` needs to encode a record
    once and count by field. Separators belong to no field."""
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in fields]
    at, spans = F.lit(0).cast("long"), []
    for v in values:
        end = at + F.length(v)
        spans.append(F.struct(at.alias("start"), end.alias("end")))
        at = end + F.lit(len(separator))
    return rows.withColumn(sections, F.array(*spans).cast(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))).withColumn(text, F.concat_ws(separator, *values))
