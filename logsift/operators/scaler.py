"""Standard scaler over the long feature table (O-M1).

mean and **population** std per event over *all* windows (a window without the event
counts as 0); a zero-variance column divides by 1. Fitted from sums, so the dense
matrix is never built: ``sum(cnt)``, ``sum(cnt²)`` per event and the window count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("server_id", "window_id")


def fit_scaler(counts: DataFrame, keys=KEYS) -> DataFrame:
    """(event_id, mean, scale) from (keys…, event_id, cnt)."""
    n_windows = counts.select(*keys).distinct().count()
    if n_windows == 0:
        raise ValueError("cannot fit a scaler on no windows")
    n = F.lit(float(n_windows))
    s = counts.groupBy("event_id").agg(F.sum("cnt").alias("s1"),
                                       F.sum(F.col("cnt").cast("double") * F.col("cnt")).alias("s2"))
    mean = F.col("s1") / n
    var = F.greatest(F.lit(0.0), F.col("s2") / n - mean * mean)
    std = F.sqrt(var)
    return s.select("event_id", mean.alias("mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias("scale"))


def scale_long(counts: DataFrame, scaler: DataFrame, keys=KEYS) -> DataFrame:
    """Scaled value of every (window, scaler event), zeros included: (keys…, event_id, value).

    The grid is built per window from a map of its counts read at the scaler's event
    list (a small, model-sized array), not by a cross join.
    """
    rows = scaler.orderBy("event_id").collect()  # one row per model feature
    vocab = [r["event_id"] for r in rows]
    means = [r["mean"] for r in rows]
    scales = [r["scale"] for r in rows]
    from .features import dense_vectors
    dv = dense_vectors(counts, vocab, keys)
    mean_a = F.array(*[F.lit(float(m)) for m in means])
    scale_a = F.array(*[F.lit(float(s)) for s in scales])
    vocab_a = F.array(*[F.lit(v) for v in vocab])
    z = F.transform("features", lambda x, i: (x - F.element_at(mean_a, i + 1)) / F.element_at(scale_a, i + 1))
    return (dv.select(*keys, F.posexplode(z).alias("idx", "value"))
              .select(*keys, F.element_at(vocab_a, F.col("idx") + 1).alias("event_id"), "value"))


def scale_vectors(vectors: DataFrame, scaler_rows: list, col: str = "features", out: str = "x") -> DataFrame:
    """Scale an array column in vocabulary order with (mean, scale) pairs held by the model."""
    mean_a = F.array(*[F.lit(float(m)) for m, _ in scaler_rows])
    scale_a = F.array(*[F.lit(float(s)) for _, s in scaler_rows])
    return vectors.withColumn(
        out, F.transform(col, lambda x, i: (x - F.element_at(mean_a, i + 1)) / F.element_at(scale_a, i + 1)))
