"""Sanitise and de-duplicate structured rows (O-D1 … O-D3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lines import is_nonblank, ts_lit

UNKNOWN = "unknown"


def sanitize(df: DataFrame, ingest_ts=None, raw: str = "raw_log") -> DataFrame:
    """O-D1: drop null/blank raw lines; missing event id/template → 'unknown';
    missing or unparseable time → ``ingest_ts``."""
    out = df.filter(is_nonblank(raw))
    for c in ("event_id", "event_template"):
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)))
        else:
            out = out.withColumn(c, F.lit(UNKNOWN))
    fallback = ts_lit(ingest_ts) if ingest_ts is not None else F.lit(None).cast("timestamp_ntz")
    if "ts" in out.columns:
        ts_type = dict(out.dtypes)["ts"]
        if ts_type == "string":
            parsed = F.try_to_timestamp(F.col("ts")).cast("timestamp_ntz")
        else:
            parsed = F.col("ts").cast("timestamp_ntz")
        out = out.withColumn("ts", F.coalesce(parsed, fallback))
    else:
        out = out.withColumn("ts", fallback)
    return out


def dedupe_first(df: DataFrame, keys=("raw_log", "event_id"), order=("line_no",)) -> DataFrame:
    """O-D2: keep the first row (by ``order``) of each ``keys`` group.

    Expressed as an aggregate (``min_by`` of the row by its order key), so copies are
    combined map-side before the shuffle: a line repeated in a third of all rows costs
    one partial row per input partition, not one giant sorted group.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys]
    order_key = F.struct(*[F.col(c) for c in order]) if len(order) > 1 else F.col(order[0])
    first = (df.groupBy(*keys)
               .agg(F.min_by(F.struct(*[F.col(c) for c in rest]), order_key).alias("_first")))
    return first.select(*keys, *[F.col("_first")[c].alias(c) for c in rest]).select(*df.columns)


def distinct_all(df: DataFrame) -> DataFrame:
    """O-D3: exact duplicates over all columns (hash aggregate, partial map-side)."""
    return df.dropDuplicates()
