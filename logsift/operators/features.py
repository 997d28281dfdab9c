"""Window × event features (O-F1 … O-F4).

The canonical form is the long table ``(server_id, window_id, event_id, cnt)``: it is
sparse, aggregates with a map-side combine, and never needs the vocabulary up front.
Models take sparse vectors: the columns are a table (event_id, idx, mean, scale) that the
counts join, a window is its (idx, value) pairs, and what a column is without a count is one
``base`` array. Rows are made dense per Arrow batch, and only in the columns that are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

KEYS = ("server_id", "window_id")


def feature_counts(df: DataFrame, keys=KEYS, event: str = "event_id") -> DataFrame:
    """O-F1: count per (window, event); only windows with rows exist."""
    return df.groupBy(*keys, F.col(event).cast("string").alias("event_id")).agg(
        F.count(F.lit(1)).alias("cnt"))


def vocabulary(counts: DataFrame) -> list[str]:
    """Sorted distinct event ids, on the driver: for the wide forms below, whose columns are a
    caller's choice. Models use ``feature_table``, which stays distributed."""
    return sorted(r[0] for r in counts.select("event_id").distinct().collect())


def feature_table(counts: DataFrame) -> DataFrame:
    """(event_id, idx): the model's columns, every event in the order of its id.

    Ids are range-partitioned and written once with their partition; a partition's first number is the count of the ids in those
    before it, and inside it rows are numbered by a window."""
    ids = counts.select("event_id").distinct().repartitionByRange("event_id").withColumn("_part", F.spark_partition_id())
    ids = materialize(ids, "features")
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    first = ids.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("event_id"))
    return ids.withColumn("_own", own).join(first, "_part").select("event_id", (F.col("_first") + F.col("_own") - 1).alias("idx"))


PAIRS = "array<struct<idx:int,v:double>>"


def sparse_vectors(counts: DataFrame, columns: DataFrame, keys=KEYS, out: str = "pairs") -> DataFrame:
    """O-F3: per window the (idx, cnt / scale) pairs of its known events; every window of ``counts``
    is kept, also one whose events are all unknown. ``columns`` has (event_id, idx, scale)."""
    x = counts.join(columns.select("event_id", "idx", "scale"), "event_id", "left")
    pair = F.when(F.col("idx").isNotNull(), F.struct(F.col("idx").cast("int").alias("idx"), (F.col("cnt") / F.col("scale")).alias("v")))
    return x.groupBy(*keys).agg(F.array_sort(F.collect_list(pair)).cast(PAIRS).alias(out))


def dense(pdf: pd.DataFrame, base: np.ndarray | None = None, columns: np.ndarray | None = None) -> np.ndarray:
    """Rows of a batch as a matrix, of all columns or of those named (sorted): from the array column ``x``,
    or from ``pairs`` on top of ``base``, which has the columns of the matrix."""
    if base is None:
        x = np.stack(pdf["x"].to_numpy()).astype(np.float64)
        return x if columns is None else x[:, columns]
    out = np.repeat(base[None, :], len(pdf), axis=0)
    sizes = [len(p) for p in pdf["pairs"]]
    rows = np.repeat(np.arange(len(pdf)), sizes)
    idx = np.array([q["idx"] for p in pdf["pairs"] for q in p], np.int64)
    val = np.array([q["v"] for p in pdf["pairs"] for q in p], np.float64)
    if columns is not None:
        at = np.minimum(np.searchsorted(columns, idx), max(0, len(columns) - 1))
        known = (columns[at] == idx) if len(columns) else np.zeros(len(idx), bool)
        rows, idx, val = rows[known], at[known], val[known]
    out[rows, idx] += val
    return out


def feature_matrix(counts: DataFrame, vocab: list[str] | None = None, keys=KEYS) -> DataFrame:
    """O-F2: wide matrix, one int column per event id (sorted, string-named), missing = 0.

    The pivot values are given explicitly, which saves Spark the distinct-values job.
    For large vocabularies use ``dense_vectors`` instead (one array column).
    """
    vocab = sorted(vocab) if vocab is not None else vocabulary(counts)
    wide = counts.groupBy(*keys).pivot("event_id", vocab).agg(F.sum("cnt"))
    return wide.select(*keys, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint").alias(v) for v in vocab])


def dense_vectors(counts: DataFrame, vocab: list[str], keys=KEYS, out: str = "features") -> DataFrame:
    """O-F3 ``align_features``: per window an array<double> in ``vocab`` order.

    Unknown events are ignored and missing ones are 0; every window of ``counts`` is kept
    (also one whose events are all unknown). No join: each window's counts become a map
    that is read at the model's column names.
    """
    vocab_arr = F.array(*[F.lit(v) for v in vocab])
    m = F.map_from_entries(F.collect_list(F.struct(F.col("event_id"), F.col("cnt").cast("double"))))
    per_window = counts.groupBy(*keys).agg(m.alias("_m"))
    return per_window.select(
        *keys,
        F.transform(vocab_arr, lambda e: F.coalesce(F.element_at(F.col("_m"), e), F.lit(0.0))).alias(out))


def aligned_long(counts: DataFrame, vocab: list[str], keys=KEYS) -> DataFrame:
    """Long form of ``dense_vectors``: (keys…, idx, event_id, cnt) for every model column."""
    dv = dense_vectors(counts, vocab, keys)
    vocab_arr = F.array(*[F.lit(v) for v in vocab])
    return dv.select(*keys, F.posexplode("features").alias("idx", "cnt")).select(
        *keys, F.col("idx").cast("bigint").alias("idx"), F.element_at(vocab_arr, F.col("idx") + 1).alias("event_id"),
        F.col("cnt").cast("bigint").alias("cnt"))


def latest_window(df: DataFrame, by: str = "server_id", window: str = "window_id") -> DataFrame:
    """O-F4: rows of the last window per server.

    ``max`` per server is a partial aggregate (skew-safe); the result has one row per
    server and joins back as a hash join that AQE broadcasts at run time.
    """
    last = df.groupBy(by).agg(F.max(window).alias("_last"))
    return (df.join(last, on=by)
              .filter(F.col(window) == F.col("_last")).drop("_last"))
