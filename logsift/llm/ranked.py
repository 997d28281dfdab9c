"""Ranked lexical search: range-maximum sparse tables per posting list, best-first over document intervals.

Documents are indexed in segments: rows that hold, for every term of the queries, the documents of the segment that have it, in order
of their ids, and how often. A query's score of a document is the sum of its terms' impacts there. In a segment each
posting list gets a sparse table that answers where its largest impact in a range is, and a query starts with the interval of
all documents, whose bound is the sum of its lists' maxima. The intervals with the highest bounds are taken, split at the document
where the strongest list has its maximum, which is scored, and the two halves get bounds of their own; what lies below the k-th
score found so far, in this segment or in an earlier one of the task, is dropped. So each segment gives its exact best, and
a window over the few rows of all segments gives the ranking.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize
from .common import arrow

TOP = 10
#: Scores: weight (1000 ln), parts of a thousand of a document's length that count, and the scale of a term's share.
LENGTH, SCALE = 90, 10**9
#: Bytes of text, documents and postings of a segment; bytes of distinct query terms up to which only those are indexed (beyond
#: it all terms are); bytes of queries that go to the workers at a time; intervals that are split at a time.
SEGMENT_BYTES, SEGMENT_DOCS, SEGMENT_POSTINGS, VOCABULARY_BYTES, SLICE_BYTES, BEAM = 16 << 20, 1 << 15, 1 << 20, 16 << 20, 16 << 20, 64
#: Bytes of a text that are split at a time.
TEXT_BYTES = 1 << 20

_BLANK = bytes(32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256)).lower()


def terms(body: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased."""
    return body.translate(_BLANK).split()


def count_terms(body: bytes, known: frozenset | None) -> tuple[int, Counter]:
    """How many terms a text has, and how often each of the known ones occurs; a long text is split slice by slice."""
    n, at, counts = 0, 0, Counter()
    body = body.translate(_BLANK)
    while at < len(body):
        end = body.find(b" ", at + TEXT_BYTES)
        found = body[at : end if end >= 0 else len(body)].split()
        n += len(found)
        counts.update(found if known is None else filter(known.__contains__, found))
        at = end if end >= 0 else len(body)
    return n, counts


def _segments(vocabulary, kind: T.DataType) -> Callable:
    """Rows of documents to segments: ids in their order (nulls last), lengths in terms, and the postings of each term."""

    def row(ids: list, held: list[tuple[int, Counter]]) -> dict:
        column = pa.array(ids, kind)
        order = pc.sort_indices(column, null_placement="at_end").to_numpy()
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        lists: dict[bytes, list[tuple[int, int]]] = {}
        for i, (_, counts) in zip(at.tolist(), held, strict=True):
            for t, tf in counts.items():
                lists.setdefault(t, []).append((i, tf))
        names, doc, tf = sorted(lists), [], []
        for t in names:
            places = sorted(lists[t])
            doc += [x for x, _ in places]
            tf += [x for _, x in places]
        return {"ids": column.take(pa.array(order)).to_pylist(), "lengths": np.array([n for n, _ in held], np.int64)[order].tolist(), "terms": names, "df": [len(lists[t]) for t in names], "docs": np.array(doc, "<i4").tobytes(), "tf": np.array(tf, "<i4").tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, held, size, postings = vocabulary.value, [], [], 0, 0
        out = pa.schema([("ids", pa.list_(kind)), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("df", pa.list_(pa.int64())), ("docs", pa.binary()), ("tf", pa.binary())])
        for b in batches:
            for i, body in zip(b.column("id").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                body = body.as_py() or b""
                n, counts = count_terms(body, known)
                if n:
                    ids.append(i)
                    held.append((n, counts))
                    size += len(body)
                    postings += len(counts)
                if size >= SEGMENT_BYTES or len(ids) >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
                    yield pa.RecordBatch.from_pylist([row(ids, held)], schema=out)
                    ids, held, size, postings = [], [], 0, 0
        if ids:
            yield pa.RecordBatch.from_pylist([row(ids, held)], schema=out)

    return run


class Index:
    """The postings of a segment with impacts (weight times the share of a term in a document) and a sparse table for ranges of
    each list: level j has the place of the maximum of 2^j postings from each place."""

    def __init__(self, seg: dict, weights: dict[bytes, int], docs: int, words: int):
        self.ids, n = seg["ids"], np.array(seg["lengths"], np.int64)
        # lengths of a corpus whose products pass 64 bits are multiplied as Python integers
        big = LENGTH * int(n.max()) * docs >= 1 << 63
        m = (100 - LENGTH) + (LENGTH * (n.astype(object) if big else n) * docs // words).astype(np.int64)
        names, df = seg["terms"], np.array(seg["df"], np.int64)
        ends = np.cumsum(df)
        self.size = len(self.ids)
        self.range = {t: (int(e - d), int(e)) for t, d, e in zip(names, df.tolist(), ends.tolist(), strict=True) if t in weights}
        doc, tf = np.frombuffer(seg["docs"], "<i4").astype(np.int64), np.frombuffer(seg["tf"], "<i4").astype(np.int64)
        weight = np.repeat([weights.get(t, 0) for t in names], df).astype(np.int64)
        self.impact = weight * (SCALE * tf // (1000 * tf + 8 * m[doc]))
        # one rising array of (list, document) finds a document's place in any list
        self.key = np.repeat(np.arange(len(names)), df) * self.size + doc
        self.number = {t: i for i, t in enumerate(names)}
        self.doc = doc
        self.level = [np.arange(len(doc), dtype=np.int32)]
        while 1 << len(self.level) <= max(df, default=0):
            half, before = 1 << len(self.level) - 1, self.level[-1]
            other = before[half:]
            self.level.append(np.where(self.impact[other] > self.impact[before[: len(other)]], other, before[: len(other)]))

    def best(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place of the maximum of each range [lo, hi) of postings, -1 for an empty one: two entries of one level."""
        out = np.full(lo.shape, -1, np.int64)
        wide = hi - lo
        for j in np.unique(np.frexp(wide[wide > 0])[1] - 1).tolist():
            at = (wide >> j) == 1
            a, b = self.level[j][lo[at]], self.level[j][hi[at] - (1 << j)]
            out[at] = np.where(self.impact[b] > self.impact[a], b, a)
        return out

    def search(self, query: list[bytes], k: int, least: int) -> list[tuple[int, int]]:
        """(score, place of the document) of the ``k`` best of score ``least`` or more, above 0; ties to the first place."""
        own = [t for t in query if t in self.range]
        if not own:
            return []
        start = np.array([self.range[t] for t in own], np.int64)
        base = np.array([self.number[t] for t in own], np.int64) * self.size
        lo, hi = start[:, 0][None], start[:, 1][None]  # of each interval (row) in each list
        left = np.zeros(1, np.int64)  # first document of each interval
        found: list[tuple[int, int]] = []
        at, bound = self._bounds(lo, hi)
        while len(lo):
            # scores below `least` and, once k are found, below the k-th, or equal to it and behind it
            floor = max(least, 1)
            stay = bound >= floor
            if len(found) == k:
                stay &= (bound > found[-1][0]) | (bound == found[-1][0]) & (left < found[-1][1])
            lo, hi, left, at, bound = lo[stay], hi[stay], left[stay], at[stay], bound[stay]
            if not len(lo):
                break
            order = np.argsort(-bound, kind="stable")
            now, rest = order[:BEAM], order[BEAM:]
            strong = np.where(at[now] >= 0, self.impact[at[now]], -1).argmax(1)
            split = self.doc[at[now][np.arange(len(now)), strong]]
            mid = np.searchsorted(self.key, base[None] + split[:, None])
            has = (mid < hi[now]) & (self.doc[np.minimum(mid, len(self.doc) - 1)] == split[:, None])
            score = np.where(has, self.impact[np.minimum(mid, len(self.doc) - 1)], 0).sum(1)
            found = sorted([*found, *((s, d) for s, d in zip(score.tolist(), split.tolist(), strict=True) if s >= floor)], key=lambda x: (-x[0], x[1]))[:k]
            new_lo, new_hi = np.concatenate([lo[now], mid + has]), np.concatenate([mid, hi[now]])
            new_left = np.concatenate([left[now], split + 1])
            new_at, new_bound = self._bounds(new_lo, new_hi)
            lo, hi, left = np.concatenate([lo[rest], new_lo]), np.concatenate([hi[rest], new_hi]), np.concatenate([left[rest], new_left])
            at, bound = np.concatenate([at[rest], new_at]), np.concatenate([bound[rest], new_bound])
        return found

    def _bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.best(lo, hi)
        return at, np.where(at >= 0, self.impact[at], 0).sum(1)


def _search(queries, k: int, docs: int, words: int, kind: T.DataType, item_kind: T.DataType) -> Callable:
    """Segments to each query's best rows there, with the k-th score of the task's earlier segments as a floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = queries.value
        best: list[list[int]] = [[] for _ in items]
        for b in batches:
            for seg in b.to_pylist():
                index, out = Index(seg, weights, docs, words), ([], [], [], [])
                for q, (number, item, query) in enumerate(items):
                    least = best[q][-1] if len(best[q]) == k else 0
                    got = index.search(query, k, least)
                    best[q] = sorted([*best[q], *(s for s, _ in got)], reverse=True)[:k]
                    for col, more in zip(out, ([number] * len(got), [item] * len(got), [index.ids[d] for _, d in got], [s for s, _ in got]), strict=True):
                        col.extend(more)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], item_kind), pa.array(out[2], kind), pa.array(out[3], pa.int64())], names=["number", "item_id", "id", "score"])

    return run


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pc.list_flatten(b.column("terms")), pc.list_flatten(b.column("df"))], names=["term", "df"])


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        each = [list(dict.fromkeys(terms(x.as_py() or b""))) for x in b.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column("number"), b.column("item_id"), pa.array(each, pa.list_(pa.binary()))], names=["number", "item_id", "terms"])


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(item_id, rank, id, score): the ``k`` documents of ``docs`` with the highest score above 0 for each row of ``items``
    (``item_col``, text); equal scores by rising id, nulls last.

    Null and empty texts have no terms: such documents don't count at all, and such items have no rows. Rows that repeat an id are documents
    of their own, and rows that repeat an item are ranked each. Other columns are not read. Segments are written once; queries go to the
    workers in slices of about ``SLICE_BYTES``, with one pass over the segments each. If all their terms are larger than
    ``VOCABULARY_BYTES``, segments hold every term instead, and nothing of the vocabulary is broadcast."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType, items.schema[item_col].dataType
    arrow_kind, arrow_item = to_arrow_type(kind), to_arrow_type(item_kind)
    numbered = items.select(F.monotonically_increasing_id().alias("number"), F.col(item_col).alias("item_id"), "text")
    queries = materialize(arrow(numbered, _terms_of, T.StructType([T.StructField("number", T.LongType()), T.StructField("item_id", item_kind), T.StructField("terms", T.ArrayType(T.BinaryType()))])), "ranked-queries")
    each = queries.select("number", F.explode("terms").alias("term"))
    vocabulary = each.select("term").distinct()
    total = vocabulary.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    known = frozenset(bytes(r.term) for r in vocabulary.collect()) if total <= VOCABULARY_BYTES else None
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("df", T.ArrayType(T.LongType())), T.StructField("docs", T.BinaryType()), T.StructField("tf", T.BinaryType())])
    segments = materialize(arrow(rows, _segments(spark.sparkContext.broadcast(known), arrow_kind), schema), "ranked-segments")
    n, words = segments.agg(F.sum(F.size("ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).first()
    df = arrow(segments.select("terms", "df"), _statistics, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = materialize(each.join(df, "term"), "ranked-weights") if n else None
    size = weighed.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0 if n else 0
    slices = max(1, -(-size // SLICE_BYTES))
    found = None
    for s in range(slices if n else 0):
        part = weighed.filter(F.pmod(F.xxhash64("number"), F.lit(slices)) == s)
        weights, by = {}, {}
        for r in part.collect():  # a slice of bounded size
            weights[bytes(r.term)] = math.floor(1000 * math.log((2 * n + 2) / (2 * r.df + 1)))
            by.setdefault(r.number, []).append(bytes(r.term))
        names = {r.number: r.item_id for r in queries.filter(F.pmod(F.xxhash64("number"), F.lit(slices)) == s).select("number", "item_id").collect()}
        query = spark.sparkContext.broadcast(([(i, names[i], sorted(ts)) for i, ts in sorted(by.items())], weights))
        more = arrow(segments, _search(query, k, n, words, arrow_kind, arrow_item), T.StructType([T.StructField("number", T.LongType()), T.StructField("item_id", item_kind), T.StructField("id", kind), T.StructField("score", T.LongType())]))
        found = more if found is None else found.unionByName(more)
    if found is None:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", item_kind), T.StructField("rank", T.IntegerType()), T.StructField("id", kind), T.StructField("score", T.LongType())]))
    order = W.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "id", "score")
