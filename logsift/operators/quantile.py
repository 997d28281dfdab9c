"""Exact percentiles of a column of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that are sorted and read at the end: a bracket around the percentile is narrowed until it holds no more.
BRACKET = 50_000
ACCURACY = 10_000


def exact_percentile(df: DataFrame, col: str, q: float, bracket: int = BRACKET) -> float:
    """The ``q`` percentile of ``col`` with linear interpolation between its two neighbours; NaN without values.

    The same rule at every size: approximate percentiles bracket the two ranks wanted, the values below
    the bracket are counted, and the bracket is narrowed until it holds at most ``bracket`` different
    values, counted per value (so a value that repeats in most rows is one row). No aggregation
    buffer holds the column.
    """
    values = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    step = 1.0 / ACCURACY
    n, lo, hi, most, least = values.agg(
        F.count("v"), F.percentile_approx("v", max(0.0, q - 2 * step), ACCURACY), F.percentile_approx("v", min(1.0, q + 2 * step), ACCURACY),
        F.max("v"), F.min("v")).first()
    if not n:
        return math.nan
    at = q * (n - 1)
    first, last = math.floor(at), math.ceil(at)
    while True:
        below, upto, different = values.agg(F.count_if(F.col("v") < lo), F.count_if(F.col("v") <= hi), F.approx_count_distinct(F.when(F.col("v").between(lo, hi), F.col("v")))).first()
        if below > first:
            lo = least
        elif upto <= last:
            hi = most
        elif lo == hi:
            return float(lo)
        elif different <= bracket // 2:
            break
        else:  # narrow it: the same inside the bracket
            inside = values.filter(F.col("v").between(lo, hi))
            share = lambda rank: (rank - below) / (upto - below)
            new = inside.agg(F.percentile_approx("v", max(0.0, share(first) - 2 * step), ACCURACY), F.percentile_approx("v", min(1.0, share(last + 1) + 2 * step), ACCURACY)).first()
            if tuple(new) == (lo, hi):
                break
            lo, hi = new
    runs = values.filter(F.col("v").between(lo, hi)).groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v")
    rank, found = below, {}
    for r in runs.toLocalIterator():
        for want in (first, last):
            if rank <= want < rank + r.n:
                found[want] = r.v
        rank += r.n
        if rank > last:
            break
    return float(found[first] * (last - at) + found[last] * (at - first)) if found[last] > found[first] else float(found[first])
