"""Exact top-k search by inner product with KD-trees per shard.

Vectors are dealt into shards of bounded size. A shard's tree splits at the median of the dimension with the widest
spread and keeps tight bounding boxes. A query visits nodes best first, by the highest inner product that any
point of the node's box could have, and ends once that falls below the k-th best score so far. Queries go through
the shards in blocks, twice: first each block searches one shard, and the k-th scores found there are then
propagated to its search of all the others, where most nodes are out of reach from the start.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .common import arrow

#: Vectors in a shard and queries in a block on average, points in a leaf.
SHARD_ROWS, BLOCK_ROWS, LEAF = 8_192, 256, 256
_EXACT = float(1 << 53)


def exact_products(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products of any size, cut to 64 bits."""
    big = points.astype(object) @ query.astype(object)
    return np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in big], np.int64)


class Tree:
    """A KD-tree over integer points with ids and row numbers (the ids, where none are given). Halves are equal in number,
    whatever values repeat."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF, rows: np.ndarray | None = None) -> None:
        self.order = np.lexsort((ids,))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []
        self.child: list[tuple[int, int]] = []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            own = points[self.order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            node = len(self.span)
            self.span.append((a, b))
            self.child.append((-1, -1))
            self.low.append(low)
            self.high.append(high)
            if parent >= 0:
                self.child[parent] = (node, self.child[parent][1]) if side == 0 else (self.child[parent][0], node)
            wide = int(np.argmax(high - low))
            if b - a > leaf and high[wide] > low[wide]:
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, wide], middle, kind="introselect")]
                stack += [(a + middle, b, node, 1), (a, a + middle, node, 0)]
        self.low_box, self.high_box = np.array(self.low, np.float64).T, np.array(self.high, np.float64).T
        for a, b in (s for s, c in zip(self.span, self.child, strict=True) if c[0] < 0):
            self.order[a:b] = self.order[a:b][np.argsort(ids[self.order[a:b]], kind="stable")]
        self.ids, self.points = ids[self.order], points[self.order]
        self.rows = self.ids if rows is None else rows[self.order]
        self.real = self.points.astype(np.float64)
        self.largest = float(np.abs(self.real).max(initial=0))

    def products(self, a: int, b: int, query: np.ndarray, real: np.ndarray, small: bool) -> np.ndarray:
        """Inner products with the points a to b: in doubles where these are exact (``small``), else in whole numbers."""
        return (self.real[a:b] @ real).astype(np.int64) if small else exact_products(self.points[a:b], query)

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """For each node the highest inner product that a point of its box can have, rounded up."""
        q = query.astype(np.float64)
        most = np.maximum(q, 0) @ self.high_box + np.minimum(q, 0) @ self.low_box
        return most + np.abs(most) * 1e-12 + 1e-6

    def search(self, query_row: int, query: np.ndarray, k: int, least: float) -> list[tuple[int, int]]:
        """The best k (score, id) of the shard's points but the query's own row, none below ``least``: by score, then by smaller
        id. ``least`` is a k-th score found elsewhere: points that reach it count still, as a tie goes to the smaller id."""
        bound, real = self.bounds(query).tolist(), query.astype(np.float64)
        small = self.largest * float(np.abs(real).max(initial=0)) * len(query) < _EXACT
        agenda = [(-bound[0], 0)]
        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
        while agenda:
            upper, node = heapq.heappop(agenda)
            if -upper < (max(least, best[0][0]) if len(best) == k else least):
                break
            left, right = self.child[node]
            if left >= 0:
                for c in (left, right):
                    heapq.heappush(agenda, (-bound[c], c))
                continue
            a, b = self.span[node]
            ids, score = self.ids[a:b], self.products(a, b, query, real, small)
            floor = max(least, best[0][0]) if len(best) == k else least
            able = np.flatnonzero((score >= floor) & (self.rows[a:b] != query_row))
            if len(able) > k:  # of one leaf only its own best k can count
                able = able[np.lexsort((ids[able], ~score[able]))[:k]]
            for i in able:
                item = (int(score[i]), -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v, dim, row): floor(scale * x) of each component as double, and a number of its own for each row, written once so
    that every use sees the same. Rows whose vector is null, empty or holds a null or a non-finite component, and rows without an id,
    take no part; rows that repeat an id stay, each for itself, with the same vector or another; components
    beyond 64 bits are cut to them."""
    x = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    finite = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    good = vectors.filter(F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size(vector_col) > 0))
    return materialize(good.select(F.col(id_col).cast("long").alias("id"), x.alias("v"), F.size(vector_col).alias("dim"), F.monotonically_increasing_id().alias("row")), "kd-vectors")


def _matrix(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _by_key(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of equal keys in rows sorted by them."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b]).combine_chunks()
        if not t.num_rows:
            continue
        cols = [t.column(c).to_numpy() for c in names]
        starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)])
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            yield tuple(c[i] for c in cols), t.slice(i, j - i).to_batches()[0]
        rest = t.slice(starts[-1])
    if rest is not None:
        yield tuple(rest.column(c)[0].as_py() for c in names), rest.combine_chunks().to_batches()[0]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per group: its ids and its points as bytes."""
    for (dim, part), b in _by_key(batches, ["dim", "part"]):
        ids, rows = b.column("id").to_numpy(), b.column("row").to_numpy()
        yield pa.RecordBatch.from_pylist([{"dim": int(dim), "part": int(part), "n": len(ids), "ids": ids.tobytes(), "own": rows.tobytes(), "points": _matrix(b, dim).tobytes()}], _PACKED)


_PACKED = pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("own", pa.binary()), ("points", pa.binary())])
_PACKED_DDL = "dim int, part long, n long, ids binary, own binary, points binary"


def _grouped(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v, dim, row) in parts of about ``size`` rows by the hash of their numbers, dimension by dimension."""
    parts = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("parts"))
    dealt = rows.join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("row"), "parts"))
    return arrow(dealt.select("dim", "part", "id", "row", "v").repartition("dim", "part").sortWithinPartitions("dim", "part", "row"), _pack, _PACKED_DDL)


def _search(k: int):
    """Rows sorted by (dim, shard, block): a shard, which is block -1, and then the blocks that search it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree = None, None
        for b in batches:
            for r in b.to_pylist():
                if r["block"] < 0:
                    shard, tree = r, None
                    continue
                if tree is None:
                    tree = Tree(np.frombuffer(shard["ids"], np.int64), np.frombuffer(shard["points"], np.int64).reshape(-1, r["dim"]), rows=np.frombuffer(shard["own"], np.int64))
                ids, own = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["own"], np.int64)
                queries = np.frombuffer(r["points"], np.int64).reshape(-1, r["dim"])
                least = np.frombuffer(r["least"], np.float64) if r["least"] else np.full(len(ids), -np.inf)
                out = [(int(i), int(o), s, v) for i, o, q, low in zip(ids, own, queries, least, strict=True) for s, v in tree.search(int(o), q, k, low)]
                q, o, s, v = (np.array(c, np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * len(out), pa.int64()), pa.array([r["dim"]] * len(out), pa.int32()), pa.array(q), pa.array(o), pa.array(s), pa.array(v)], names=["block", "dim", "query_id", "query_row", "score", "vec_id"])

    return run


_FOUND = "block long, dim int, query_id long, query_row long, score long, vec_id long"


def _propagate(k: int):
    """Adds to each block the k-th scores that its queries have so far (-inf where there are fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = []
            for r in b.select(["own", "found"]).to_pylist():
                scores: dict[int, list[int]] = {}
                for f in r["found"] or []:
                    scores.setdefault(f["query_row"], []).append(f["score"])
                least.append(np.array([min(s) if len(s := scores.get(int(i), [])) >= k else -np.inf for i in np.frombuffer(r["own"], np.int64)], np.float64).tobytes())
            yield b.drop_columns(["found"]).append_column("least", pa.array(least, pa.binary()))

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k rows of ``vectors`` with the highest integer inner
    products but itself, ties to the smaller id; all if there are fewer. Both are rows of one table as ``quantise`` gives it, and
    a query is told from the other rows with its id by its row number; queries that repeat an id have rows each. Vectors of different lengths are never compared, so a query may have no result.

    Trees and blocks are bounded in size and their number grows with the tables. Each block meets each shard once: the work is
    a product of blocks and shards, and no pair of vectors is ever a row."""
    shards = materialize(_grouped(vectors, shard_rows), "kd-shards").select("dim", F.col("part").alias("shard"), "ids", "own", "points")
    blocks = materialize(_grouped(queries, block_rows), "kd-blocks").select("dim", F.col("part").alias("block"), "n", "ids", "own", "points")
    count = shards.groupBy("dim").agg(F.count(F.lit(1)).alias("shards"))
    todo = blocks.join(count, "dim")
    home = F.pmod("block", "shards")

    def searched(b: DataFrame) -> DataFrame:
        rows = b.select("dim", "shard", "block", "ids", "own", "points", "least")
        trees = shards.select("dim", "shard", F.lit(-1).cast("long").alias("block"), "ids", "own", "points", F.lit(None).cast("binary").alias("least"))
        return arrow(trees.unionByName(rows).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "block"), _search(k), _FOUND)

    first = materialize(searched(todo.withColumn("shard", home).withColumn("least", F.lit(None).cast("binary"))), "kd-first")
    have = first.groupBy("dim", "block").agg(F.collect_list(F.struct("query_row", "score")).alias("found"))  # k for each query of a block
    known = todo.join(have, ["dim", "block"], "left").select("dim", "block", "shards", "ids", "own", "points", "found")
    known = arrow(known, _propagate(k), "dim int, block long, shards long, ids binary, own binary, points binary, least binary")
    rest = known.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).filter(F.col("shard") != home)
    found = first.unionByName(searched(rest))
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
