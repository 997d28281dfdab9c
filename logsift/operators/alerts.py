"""Alerts: levels, throttling, suppression, messages, listing and stats (O-A1, A3, A5–A7).

The throttle/suppress rule is a state machine (whether a row emits depends on earlier
decisions), which no window function expresses. It forgets everything where a server is silent for
longer than both times, so a server's rows are cut there into episodes, each of which is streamed through the
machine by itself: tasks hold the last emitted time and the suppressions that run, never a
server's rows, and a server's episodes spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT
from ..session import materialize, ship_package
from ..functions.lines import ts_lit
from ..functions.scores import alert_level, fmt3

EMITTED, SUPPRESSED, DROPPED = "emitted", "suppressed", "dropped"


def _micros(ts):
    return F.timestamp_diff("MICROSECOND", ts_lit("1970-01-01 00:00:00"), F.col(ts).cast("timestamp_ntz"))


class Machine:
    """Decisions for one server's alert rows, given in time order; times in microseconds."""

    def __init__(self, throttle_us: int, suppress_us: int, last: int | None = None, ends: dict | None = None):
        self.throttle, self.suppress, self.last, self.ends = throttle_us, suppress_us, last, dict(ends or {})

    def decide(self, t: int, key: str) -> str:
        if self.last is not None and t - self.last < self.throttle:
            return DROPPED
        end = self.ends.get(key)
        if end is not None and t <= end:
            return SUPPRESSED  # recorded, does not move the throttle clock
        if end is None:  # a new key: forget those that have run out
            self.ends = {k: e for k, e in self.ends.items() if e >= t}
        self.last = t
        self.ends[key] = t + self.suppress
        return EMITTED


def run_machine(t_us: np.ndarray, keys: np.ndarray, throttle_us: int, suppress_us: int) -> list[str]:
    """Decisions for one server's alert rows in time order."""
    m = Machine(throttle_us, suppress_us)
    return [m.decide(t, k) for t, k in zip(t_us.tolist(), keys.tolist())]


def alerting(scores: DataFrame) -> DataFrame:
    """The rows that are not NORMAL with their level, time in microseconds (_t) and suppression key (_key)."""
    df = scores
    if "root_cause" not in df.columns:
        df = df.withColumn("root_cause", F.array().cast("array<string>"))
    return (df.select("server_id", "window_id", "ts", "score", "root_cause")
              .withColumn("level", alert_level("score")).filter(F.col("level") != "NORMAL")
              .withColumn("_t", _micros("ts"))
              .withColumn("_key", F.concat_ws("|", F.col("server_id"), F.col("level"),
                                              F.array_join(F.array_sort("root_cause"), ","))))


#: Width of the time cuts in which gaps are looked for, in the gaps that end an episode.
CUT_GAPS = 64


def episodes(alerts: DataFrame, gap_us: int) -> DataFrame:
    """``alerts`` (server_id, _t, window_id, …) with ``episode``, the time of the first row of its episode: rows of a server are in one
    episode where no gap between them is longer than ``gap_us``.

    Gaps and islands in two levels, so that no task sorts a server's whole series: rows are windowed per (server, time cut), and what a cut
    needs of those before it (their last row and the last start of an episode) comes from tables of one row a cut."""
    x = materialize(alerts.withColumn("_cut", F.floor(F.col("_t") / F.lit(max(1_000_000, gap_us) * CUT_GAPS)).cast("long")), "alert-rows")
    own = Window.partitionBy("server_id", "_cut").orderBy("_t", "window_id")

    ahead = Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)

    def from_before(rows: DataFrame, value: str, name: str) -> DataFrame:
        cuts = rows.groupBy("server_id", "_cut").agg(F.max(value).alias("_own"))
        cuts = cuts.select(F.col("server_id").alias("_s"), F.col("_cut").alias("_c"), "_own").select("_s", "_c", F.max("_own").over(ahead).alias(name))
        return rows.join(cuts, F.col("server_id").eqNullSafe(F.col("_s")) & (F.col("_cut") == F.col("_c"))).drop("_s", "_c")

    x = from_before(x, "_t", "_before").withColumn("_prev", F.coalesce(F.lag("_t").over(own), F.col("_before")))
    x = x.withColumn("_start", F.when(F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") > F.lit(gap_us)), F.col("_t")))
    x = from_before(x, "_start", "_carried")
    return x.withColumn("episode", F.coalesce(F.max("_start").over(own), F.col("_carried"))).drop("_cut", "_before", "_prev", "_start", "_carried")


def generate_alerts(scores: DataFrame, throttle: int = DEFAULT.throttle_seconds,
                    suppress: int = DEFAULT.suppress_seconds, keep_dropped: bool = False) -> DataFrame:
    """O-A3 + O-A5: alerts from a score series (server_id, window_id, ts, score[, root_cause]).

    Returns the emitted and suppressed alerts (dropped rows only with ``keep_dropped``) with
    level, message, root_cause and the ``suppressed`` flag; event time replaces wall clock.
    """
    thr, sup = throttle * 1_000_000, suppress * 1_000_000
    df = episodes(alerting(scores), max(thr, sup))
    out_schema = T.StructType([*df.schema.fields, T.StructField("decision", T.StringType())])

    def machine(batches):
        open_, m = None, None
        for pdf in batches:
            decisions = []
            for s, e, t, k in zip(pdf["server_id"], pdf["episode"].tolist(), pdf["_t"].tolist(), pdf["_key"], strict=True):
                if m is None or (s, e) != open_:
                    open_, m = (s, e), Machine(thr, sup)
                decisions.append(m.decide(t, k))
            pdf["decision"] = pd.Series(decisions, dtype=object)
            yield pdf

    ship_package(df.sparkSession)
    decided = df.repartition("server_id", "episode").sortWithinPartitions("server_id", "episode", "_t", "window_id").mapInPandas(machine, out_schema)
    if not keep_dropped:
        decided = decided.filter(F.col("decision") != DROPPED)
    return with_message(decided.withColumn("suppressed", F.col("decision") == SUPPRESSED)).drop(
        "_t", "_key", "episode")


def with_message(alerts: DataFrame) -> DataFrame:
    """O-A5: alert text; the first three causes are named when there are any."""
    base = F.concat(F.lit("["), F.col("level"), F.lit("] Anomaly detected on "), F.col("server_id"),
                    F.lit(" (score: "), fmt3("score"), F.lit(")"))
    causes = F.array_join(F.slice("root_cause", 1, 3), ", ")
    full = F.when(F.size("root_cause") > 0, F.concat(base, F.lit(". Top events: "), causes)).otherwise(base)
    short = F.concat(F.lit("Anomaly detected on "), F.col("server_id"))
    return alerts.withColumn("message", F.when(F.col("suppressed"), short).otherwise(full))


def recent_alerts(alerts: DataFrame, limit: int = 50, level: str | None = None) -> DataFrame:
    """O-A6: the last ``limit`` alerts (by ts, then server), *then* the level filter."""
    last = alerts.orderBy(F.col("ts").desc(), F.col("server_id").desc()).limit(limit)
    return last.filter(F.col("level") == level) if level else last


def threshold_table(spark, levels=DEFAULT.levels):
    """O-A2: the alert thresholds, most severe first: (rank, level, upper_bound)."""
    return spark.createDataFrame([(i, n, float(b)) for i, (n, b) in enumerate(sorted(levels, key=lambda x: x[1]))],
                                 "rank int, level string, upper_bound double")


def alert_stats(alerts: DataFrame, as_of) -> DataFrame:
    """O-A7: count per level and in total (level null), and how many are younger than
    24 h at ``as_of``; suppressed alerts are included."""
    age = F.timestamp_diff("MICROSECOND", F.col("ts").cast("timestamp_ntz"), ts_lit(as_of))
    return alerts.rollup("level").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.count_if(age < 86_400 * 1_000_000).alias("recent_24h"))
