"""Windows over structured rows (O-W1, O-W2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lines import ts_lit


def time_origin(df: DataFrame, ts: str = "ts"):
    """Minimum event time: one scalar aggregate over the pruned ``ts`` column."""
    return df.agg(F.min(F.col(ts).cast("timestamp_ntz")).alias("t0")).first()["t0"]


def time_windows(df: DataFrame, seconds: int = 60, ts: str = "ts", origin=None) -> DataFrame:
    """O-W1: tumbling windows of ``seconds`` from the data's own minimum time.

    Adds ``window_id`` = floor((ts - t0) / seconds) and ``window_start``; rows without a
    time are dropped. The origin is a scalar (one small aggregate, read back as a literal),
    so the window id is a per-row expression with no join and no shuffle.
    """
    df = df.filter(F.col(ts).isNotNull())
    t0 = origin if origin is not None else time_origin(df, ts)
    if t0 is None:  # empty input
        return df.withColumn("window_id", F.lit(None).cast("bigint")).withColumn(
            "window_start", F.lit(None).cast("timestamp_ntz"))
    t0c = ts_lit(t0)
    wid = F.floor(F.timestamp_diff("MICROSECOND", t0c, F.col(ts).cast("timestamp_ntz"))
                  / F.lit(seconds * 1_000_000)).cast("bigint")
    return (df.withColumn("window_id", wid)
              .withColumn("window_start",
                          F.timestamp_add("SECOND", F.col("window_id") * seconds, t0c)))


def epoch_windows(df: DataFrame, seconds: int = 60, ts: str = "ts") -> DataFrame:
    """Tumbling windows aligned to the epoch (what a stream uses: it has no minimum)."""
    e0 = ts_lit("1970-01-01 00:00:00")
    wid = F.floor(F.timestamp_diff("MICROSECOND", e0, F.col(ts).cast("timestamp_ntz"))
                  / F.lit(seconds * 1_000_000)).cast("bigint")
    return (df.filter(F.col(ts).isNotNull()).withColumn("window_id", wid)
              .withColumn("window_start", F.timestamp_add("SECOND", F.col("window_id") * seconds, e0)))


def line_windows(df: DataFrame, size: int = 100, line_no: str = "line_no") -> DataFrame:
    """O-W2: ``window_id = line_no div size`` (line numbers are assigned before any drop)."""
    return df.withColumn("window_id", F.floor(F.col(line_no) / F.lit(size)).cast("bigint"))
