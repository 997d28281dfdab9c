"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased words without punctuation. A window of ``min_match`` words of a document whose
Karp-Rabin hash is that of a window of a benchmark item, and whose words are the same, is a seed. Seeds of
a (document, item) pair are joined along diagonals into maximal matches, and the longest match whose words
are all unmarked on both sides is marked, again and again, until none of ``min_match`` words is left: the
matches then tile the item. An item whose tiles cover enough of its words is in the document,
whatever the order of its passages there.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow, utf8_bodies

#: Shortest match in words, share of an item's words that its tiles must cover, and the bytes of benchmark text that
#: go to the workers at a time (a larger benchmark is taken in slices of that size, one pass each).
MIN_MATCH, MIN_COVERAGE, SLICE_BYTES = 5, 0.8, 16 << 20
#: Seeds that are held at a time.
SEEDS = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_TO_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def split_words(body: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of any bytes beyond ASCII."""
    return body.translate(_TO_WORDS).split()


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2^64) of all windows of ``n`` ids."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n):
        out = out * _BASE + ids[k : k + len(out)].astype(np.uint64) + np.uint64(1)
    return out


@dataclass
class Index:
    """The windows of a slice of the benchmark, sorted by hash."""

    vocab: dict[bytes, int]
    ids: np.ndarray  # of all items, one after another
    start: np.ndarray  # of each item in ids, and the end
    names: list  # item ids
    hashes: np.ndarray
    at: np.ndarray  # place in ids of each hash's window
    min_match: int


def build_index(items: list[tuple], min_match: int = MIN_MATCH) -> Index:
    vocab: dict[bytes, int] = {}
    parts = [np.array([vocab.setdefault(w, len(vocab)) for w in split_words((t or "").encode())], np.int64) for _, t in items]
    start = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
    at = np.concatenate([s + np.arange(max(0, len(p) - min_match + 1)) for s, p in zip(start, parts, strict=False)] or [np.zeros(0, np.int64)]).astype(np.int64)
    ids = np.concatenate([*parts, np.zeros(0, np.int64)])
    hashes = rolling(ids, min_match)[at] if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((at, hashes))
    return Index(vocab, ids, start, [i for i, _ in items], hashes[order], at[order], min_match)


def seed_blocks(index: Index, body: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in the document's words, in the index's ids) of equal windows, in order of the document: about ``SEEDS`` of them at a
    time, whatever repeats (a window alone may have as many as the slice has places)."""
    n, get = index.min_match, index.vocab.get
    ids = np.array([get(w, -1) for w in split_words(body)], np.int64)
    if len(ids) < n or not len(index.hashes):
        return
    unknown = np.r_[0, np.cumsum(ids < 0)]
    where = np.flatnonzero(unknown[n:] == unknown[:-n])
    if not len(where):
        return
    h = rolling(ids, n)[where]
    lo, hi = np.searchsorted(index.hashes, h, "left"), np.searchsorted(index.hashes, h, "right")
    some = np.flatnonzero(hi > lo)
    where, lo, many = where[some], lo[some], (hi - lo)[some]
    block = np.cumsum(many) // SEEDS
    edges = np.r_[np.flatnonzero(np.r_[len(block) > 0, block[1:] != block[:-1]]), len(block)]
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        count = many[a:z]
        i = np.repeat(where[a:z], count)
        j = index.at[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[a:z], count)]
        same = np.ones(len(i), bool)
        for k in range(n):
            same &= ids[i + k] == index.ids[j + k]
        yield i[same], j[same]


def seeds(index: Index, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All places of equal windows."""
    none = np.zeros(0, np.int64)
    parts = [*seed_blocks(index, body), (none, none)]
    return np.concatenate([i for i, _ in parts]), np.concatenate([j for _, j in parts])


def _runs(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the document, place in the ids, seeds) of the longest runs of seeds along a diagonal."""
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    breaks = np.flatnonzero(np.r_[len(i) > 0, (np.diff(i) != 1) | (np.diff(j) != 1)])
    return i[breaks], j[breaks], np.diff(np.r_[breaks, len(i)])


def match_arrays(index: Index, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the document, place in the ids, words) of all maximal matches. Seeds become runs block by block, and a run that ends where
    a block does goes on in the next, so what is held is one block and the matches, of which a diagonal has few."""
    done: list[tuple] = []
    open_ = tuple(np.zeros(0, np.int64) for _ in range(3))
    for i, j in seed_blocks(index, body):
        if not len(i):
            continue
        start, at, size = _runs(i, j)
        # a run that begins where an open one of its diagonal ends is one with it
        order = np.lexsort((np.r_[open_[0], start], np.r_[open_[0] - open_[1], start - at]))
        s, a, n = np.r_[open_[0], start][order], np.r_[open_[1], at][order], np.r_[open_[2], size][order]
        new = np.r_[True, (s[1:] - a[1:] != s[:-1] - a[:-1]) | (s[1:] != s[:-1] + n[:-1])]
        first = np.flatnonzero(new)
        s, a, n = s[first], a[first], np.add.reduceat(n, first)
        goes_on = s + n > i.max()  # of the last window that the block has seen
        done.append((s[~goes_on], a[~goes_on], n[~goes_on]))
        open_ = s[goes_on], a[goes_on], n[goes_on]
    done.append(open_)
    s, a, n = (np.concatenate([d[k] for d in done]) for k in range(3))
    return s, a, n + index.min_match - 1


def maximal_matches(i: np.ndarray, j: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """(place in the document, place in the item, words) of the longest runs of seeds along a diagonal."""
    s, a, n = _runs(i, j)
    return list(zip(s.tolist(), a.tolist(), (n + min_match - 1).tolist(), strict=True))


def tile(matches: list[tuple[int, int, int]], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: the longest match first (ties: earlier in the document, then in the item). A match that meets
    marked words is cut into its unmarked parts, which wait for their own length's turn."""
    heap = [(-n, i, j) for i, j, n in matches]
    heapq.heapify(heap)
    seen_i: set[int] = set()
    seen_j: set[int] = set()
    tiles = []
    while heap:
        n, i, j = heapq.heappop(heap)
        free = [k for k in range(-n) if i + k not in seen_i and j + k not in seen_j]
        if len(free) == -n:
            tiles.append((i, j, -n))
            seen_i.update(range(i, i - n))
            seen_j.update(range(j, j - n))
            continue
        run = 0
        for at, k in enumerate(free):
            run = run + 1 if at and free[at - 1] == k - 1 else 1
            if run >= min_match and (at + 1 == len(free) or free[at + 1] != k + 1):
                heapq.heappush(heap, (-run, i + k - run + 1, j + k - run + 1))
    return tiles


def coverage(index: Index, body: bytes, min_coverage: float) -> Iterator[tuple[int, int, int, int]]:
    """(item number, tiles, covered words, words) of every item that a text covers. An item whose seeds together do not
    touch enough words is passed over, as its tiles cover no more than they do."""
    i, j, n = match_arrays(index, body)
    if not len(i):
        return
    item = np.searchsorted(index.start, j, "right") - 1
    for k in np.unique(item):
        own = item == k
        words = int(index.start[k + 1] - index.start[k])
        edge = np.zeros(words + 1, np.int64)
        np.add.at(edge, j[own] - index.start[k], 1)
        np.add.at(edge, j[own] + n[own] - index.start[k], -1)
        if (np.cumsum(edge[:-1]) > 0).sum() < min_coverage * words:
            continue
        tiles = tile(list(zip(i[own].tolist(), j[own].tolist(), n[own].tolist(), strict=True)), index.min_match)
        covered = sum(n for _, _, n in tiles)
        if covered >= min_coverage * words:
            yield int(k), len(tiles), covered, words


def _matcher(index, min_coverage: float, item_kind: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for b in batches:
            got = [(r, *x) for r, body in enumerate(utf8_bodies(b.column("text"))) for x in coverage(ix, body, min_coverage)]
            took = pa.array([x[0] for x in got], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id").take(took), b.column("text_key").take(took), pa.array([ix.names[x[1]] for x in got], item_kind), *(pa.array([x[c] for x in got], pa.int32()) for c in (2, 3, 4)), pa.array([x[3] / x[4] for x in got], pa.float64())], names=["id", "text_key", "item_id", "n_tiles", "covered_words", "item_words", "coverage"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, slice_bytes: int = SLICE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, item_id, n_tiles, covered_words, item_words, coverage) of every row of ``docs`` and every item of
    ``benchmark`` (item_id, text) that it covers to ``min_coverage`` at least.

    The benchmark goes to the workers in slices of about ``slice_bytes`` bytes of text, with one pass over ``docs`` each; its
    size is summed first, so no slice outgrows them. Null and empty texts match nothing, nor do items of fewer
    than ``min_match`` words; an item_id may be null or of any type; words that repeat make many matches, but seeds are held
    ``SEEDS`` at a time; repeated rows each give their own result, as do items that repeat an item_id. Extra
    columns are ignored; an empty table on either side gives an empty result."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, text_key long, item_id {benchmark.schema["item_id"].dataType.simpleString()}, n_tiles int, covered_words int, item_words int, coverage double"
    items, item_kind = benchmark.select("item_id", "text"), to_arrow_type(benchmark.schema["item_id"].dataType)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-total // slice_bytes))
    found = []
    for k in range(slices):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).orderBy("item_id", "text").collect()
        index = spark.sparkContext.broadcast(build_index([tuple(r) for r in part], min_match))
        found.append(arrow(rows, _matcher(index, min_coverage, item_kind), schema))
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``docs`` without the rows that cover a benchmark item."""
    hit = contaminated(docs, benchmark, min_match, min_coverage).select(F.col("id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    left = own.join(hit, own["id"].eqNullSafe(hit["_id"]) & (own["key"] == hit["_key"]), "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
