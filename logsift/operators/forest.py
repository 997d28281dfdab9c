"""Isolation forest as Spark jobs (O-M2, O-M3); algorithm of Liu, Ting and Zhou (ICDM 2008).

Training draws ``max_samples`` rows per tree without replacement by seeded hashes and
grows each tree in one bounded ``applyInPandas`` group (≤ max_samples rows, depth ≤
ceil(log2 max_samples)). The nodes (≤ trees × (2·max_samples − 1) rows) are the model;
scoring broadcasts them and walks every row of an Arrow batch through all trees one level
at a time with array indexing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT
from ..session import materialize, ship_package
from .features import dense
from .quantile import exact_percentile

NODE_SCHEMA = T.StructType([
    T.StructField("tree_id", T.IntegerType()),
    T.StructField("node_id", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("size", T.LongType()),
    T.StructField("depth", T.IntegerType()),
])

EULER = 0.5772156649015329


def avg_path_length(n) -> np.ndarray:
    """c(n): average path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int, tree_id: int) -> list[tuple]:
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, 0)]  # rows, depth, parent, side
    while stack:
        rows, depth, parent, side = stack.pop()
        nid = len(nodes)
        nodes.append([tree_id, nid, -1, 0.0, -1, -1, int(len(rows)), depth])
        if parent >= 0:
            nodes[parent][4 if side == 0 else 5] = nid
        if depth >= max_depth or len(rows) <= 1:
            continue
        sub = x[rows]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if not len(usable):
            continue
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < thr
        nodes[nid][2], nodes[nid][3] = f, thr
        stack.append((rows[~go_left], depth + 1, nid, 1))
        stack.append((rows[go_left], depth + 1, nid, 0))
    return [tuple(n) for n in nodes]


def _vector(df: DataFrame) -> str:
    return "pairs" if "pairs" in df.columns else "x"


def sample_for_trees(vectors: DataFrame, n: int, keys: list[str], n_trees: int, psi: int, seed: int) -> DataFrame:
    """(tree_id, x or pairs) with ``psi`` rows per tree, drawn without replacement by seeded hashes.

    One rule at every size: a row has a hash in [0, 1) for each tree, goes to the trees where it is
    below 2·psi / n, and each tree keeps its ``psi`` lowest. So about 2·trees·psi rows leave the
    scan (all of them where n is below 2·psi). ``row_number() <= psi`` is a window group limit.
    """
    share = min(1.0, 2.0 * psi / n)
    u = lambda t: F.pmod(F.xxhash64(F.col("_key"), t, F.lit(seed)), F.lit(1 << 31)) / F.lit(float(1 << 31))
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: u(t) < share)
    x = vectors.withColumn("_key", F.xxhash64(*keys)).select(_vector(vectors), "_key", *keys, F.explode(trees).alias("tree_id"))
    w = Window.partitionBy("tree_id").orderBy(u(F.col("tree_id")), *keys)
    return x.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= psi).select("tree_id", _vector(vectors))


def fit_forest(vectors: DataFrame, keys: list[str], n_trees: int = DEFAULT.n_trees,
               max_samples: int = DEFAULT.max_samples, seed: int = DEFAULT.seed,
               n: int | None = None, base: np.ndarray | None = None) -> tuple[pd.DataFrame, dict]:
    """Grow the forest on ``vectors`` (keys…, x array<double>, or pairs over ``base``). Returns (nodes, meta).

    Of sparse rows a tree sees the columns that its sample has a count in; all others are constant there."""
    n = vectors.count() if n is None else n
    if n == 0:
        raise ValueError("cannot train an isolation forest on no rows")
    psi = min(max_samples, n)
    max_depth = max(1, math.ceil(math.log2(max(psi, 2))))
    sample = sample_for_trees(vectors, n, keys, n_trees, psi, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(pdf["tree_id"].iloc[0])
        cols = None if base is None else np.unique(np.array([q["idx"] for p in pdf["pairs"] for q in p], np.int64))
        rng = np.random.default_rng([seed, tree_id])
        nodes = pd.DataFrame(_grow(dense(pdf, None if base is None else base[cols], cols), rng, max_depth, tree_id), columns=[f.name for f in NODE_SCHEMA.fields])
        if cols is not None and len(cols):
            inner = nodes["feature"] >= 0
            nodes.loc[inner, "feature"] = cols[nodes.loc[inner, "feature"].to_numpy()]
        return nodes

    ship_package(vectors.sparkSession)
    nodes = sample.groupBy("tree_id").applyInPandas(grow, NODE_SCHEMA).toPandas()  # bounded: trees × 2·psi
    return nodes, {"psi": psi, "max_depth": max_depth, "n_trees": n_trees, "n_train": n}


class ForestArrays:
    """Node arrays of all trees, padded to one width, for vectorised traversal."""

    def __init__(self, nodes: pd.DataFrame, psi: int):
        nodes = nodes.sort_values(["tree_id", "node_id"])
        self.n_trees = int(nodes["tree_id"].max()) + 1
        width = int(nodes.groupby("tree_id")["node_id"].max().max()) + 1
        shape = (self.n_trees, width)
        self.feature = np.full(shape, -1, dtype=np.int64)
        self.threshold = np.zeros(shape)
        self.left = np.zeros(shape, dtype=np.int64)
        self.right = np.zeros(shape, dtype=np.int64)
        self.leaf_len = np.zeros(shape)
        t, i = nodes["tree_id"].to_numpy(), nodes["node_id"].to_numpy()
        self.feature[t, i] = nodes["feature"].to_numpy()
        self.threshold[t, i] = nodes["threshold"].to_numpy()
        self.left[t, i] = nodes["left"].to_numpy()
        self.right[t, i] = nodes["right"].to_numpy()
        self.leaf_len[t, i] = nodes["depth"].to_numpy() + avg_path_length(nodes["size"].to_numpy())
        self.c_psi = float(avg_path_length(np.array([psi]))[0])
        self.max_depth = int(nodes["depth"].max())
        # the columns that the trees read, and each node's place among them
        self.columns = np.unique(self.feature[self.feature >= 0])
        inner = self.feature >= 0
        self.feature[inner] = np.searchsorted(self.columns, self.feature[inner])

    def score_samples(self, x: np.ndarray) -> np.ndarray:
        """-2^(-E[h(x)] / c(psi)) for every row of ``x``, which has the columns ``self.columns``."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(self.n_trees):
            idx = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.max_depth + 1):
                f = self.feature[t, idx]
                inner = f >= 0
                if not inner.any():
                    break
                val = x[rows, np.where(inner, f, 0)] if x.shape[1] else np.zeros(len(x))
                nxt = np.where(val < self.threshold[t, idx], self.left[t, idx], self.right[t, idx])
                idx = np.where(inner, nxt, idx)
            total += self.leaf_len[t, idx]
        return -np.power(2.0, -(total / self.n_trees) / self.c_psi)


def score_forest(vectors: DataFrame, nodes: pd.DataFrame, psi: int, offset: float | None = None,
                 base: np.ndarray | None = None) -> DataFrame:
    """O-M3: adds ``if_raw`` (score_samples) and, with an offset, ``if_score`` and ``if_prediction``."""
    spark = vectors.sparkSession
    forest = ForestArrays(nodes, psi)
    # bounded by the trees: their nodes, and what the columns that they read are without a count
    arrays = spark.sparkContext.broadcast((forest, None if base is None else base[forest.columns]))
    schema = T.StructType(vectors.schema.fields + [T.StructField("if_raw", T.DoubleType())])

    def run(batches):
        forest, zero = arrays.value
        for pdf in batches:
            if len(pdf):
                pdf["if_raw"] = forest.score_samples(dense(pdf, zero, forest.columns))
            else:
                pdf["if_raw"] = pd.Series(dtype="float64")
            yield pdf

    ship_package(vectors.sparkSession)
    out = vectors.mapInPandas(run, schema)
    if offset is not None:
        out = (out.withColumn("if_score", F.col("if_raw") - F.lit(float(offset)))
                  .withColumn("if_prediction", F.when(F.col("if_score") < 0, -1).otherwise(1)))
    return out


def leaf_path(depth, size) -> F.Column:
    """Path length of a leaf: its depth and the average path length of the rows that it holds."""
    n = F.col(size).cast("double") if isinstance(size, str) else size
    rest = F.when(n > 2, 2.0 * (F.log(n - 1.0) + F.lit(EULER)) - 2.0 * (n - 1.0) / n).when(n == 2, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.col(depth).cast("double") + rest


def walk_forest(rows: DataFrame, nodes: DataFrame, keys: list[str], psi: int, levels: int, x: str = "x") -> DataFrame:
    """O-M3 without Python: (keys…, if_raw) of every row by joins with the node table, level by level.

    A row is one row per tree, at the root; each of ``levels`` joins on (tree_id, node_id) takes it to a child or leaves it at its leaf, and
    one more gives the leaf's path length. Nodes are as many as the trees have, whatever the data: Spark broadcasts
    them below its size threshold and shuffles by node above it. The result is that of ``score_forest``."""
    trees = nodes.select("tree_id").distinct()
    n_trees = trees.count()
    ids = F.array(*[F.lit(r.tree_id) for r in trees.orderBy("tree_id").toLocalIterator()])  # one number a tree
    at = rows.select(*keys, F.col(x).alias("_x"), F.explode(ids).alias("tree_id"), F.lit(0).alias("node_id"))
    inner = nodes.filter(F.col("feature") >= 0).select("tree_id", "node_id", "feature", "threshold", "left", "right")
    for _ in range(levels):
        child = F.when(F.element_at("_x", F.col("feature") + 1) < F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        moved = at.join(inner, ["tree_id", "node_id"], "left")
        at = moved.select(*keys, "_x", "tree_id", F.when(F.col("feature").isNull(), F.col("node_id")).otherwise(child).alias("node_id"))
    leaves = nodes.select("tree_id", "node_id", leaf_path("depth", "size").alias("_path"))
    paths = at.drop("_x").join(leaves, ["tree_id", "node_id"]).groupBy(*keys).agg(F.sum("_path").alias("_path"))
    c_psi = float(avg_path_length(np.array([psi]))[0])
    return paths.select(*keys, (-F.pow(F.lit(2.0), -(F.col("_path") / n_trees) / c_psi)).alias("if_raw"))


def forest_offset(scored: DataFrame, contamination: float = DEFAULT.contamination) -> float:
    """Offset = percentile (linear) of the training ``score_samples`` at ``contamination``; rows are scored once, for all of its passes."""
    return exact_percentile(materialize(scored.select("if_raw"), "if-raw"), "if_raw", contamination)
