"""Monitoring analytics over a per-server score series (O-A8 … O-A26).

Input is a scores frame ``(server_id, window_id, ts, score, prediction, …)`` with one row
per closed window. Every ordered computation is a window ``partitionBy(server_id)``
ordered by ``(ts, window_id)``; the rows of a server are its windows (time span / width),
not its log lines, so a server that emits a third of all lines still has a bounded series.
Windows that share a partition/order spec are evaluated in one sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.lines import is_error_line
from ..functions.scores import health_score, mean6, prediction

SERVER = "server_id"
ORDER = ("ts", "window_id")


def _ordered(by=SERVER, order=ORDER, desc=False):
    cols = [F.col(c).desc() if desc else F.col(c) for c in order]
    return Window.partitionBy(by).orderBy(*cols)


def _frame(lo, hi, by=SERVER, order=ORDER):
    return _ordered(by, order).rowsBetween(lo, hi)


# ---------------------------------------------------------------- drift (A8–A10)

def prediction_distribution(df: DataFrame, by=SERVER) -> DataFrame:
    """O-A8: share of 1 and of -1 per server (0 for an empty input)."""
    return df.groupBy(by).agg(
        F.coalesce(F.avg((F.col("prediction") == 1).cast("double")), F.lit(0.0)).alias("p_normal"),
        F.coalesce(F.avg((F.col("prediction") == -1).cast("double")), F.lit(0.0)).alias("p_anomaly"))


def drift(df: DataFrame, window: int = DEFAULT.drift_window, threshold: float = DEFAULT.drift_threshold,
          baseline: DataFrame | None = None, retrain_trigger: bool = DEFAULT.retrain_trigger) -> DataFrame:
    """O-A9/A10: drift of the last ``window`` predictions against a baseline.

    Rows appear once a server's window is full. Without a ``baseline`` table
    (server_id, p_normal, p_anomaly) the first full window is the baseline, and that row
    itself reports no drift. drift = (|Δnormal| + |Δanomaly|) / 2, flagged when > threshold.
    """
    fr = _frame(-(window - 1), 0)
    x = df.select(
        SERVER, "window_id", "ts", "prediction",
        F.count(F.lit(1)).over(fr).alias("_n"),
        F.avg((F.col("prediction") == 1).cast("double")).over(fr).alias("p_normal"),
        F.avg((F.col("prediction") == -1).cast("double")).over(fr).alias("p_anomaly"),
    ).filter(F.col("_n") == window)
    if baseline is None:
        first = _frame(Window.unboundedPreceding, 0)
        x = x.select("*",
                     F.first("p_normal").over(first).alias("base_normal"),
                     F.first("p_anomaly").over(first).alias("base_anomaly"),
                     (F.row_number().over(_ordered()) == 1).alias("_is_base"))
    else:
        b = baseline.select(SERVER, F.col("p_normal").alias("base_normal"),
                            F.col("p_anomaly").alias("base_anomaly"))
        # one row per server: AQE broadcasts it at run time when it is small
        x = x.join(b, SERVER).withColumn("_is_base", F.lit(False))
    d = (F.abs(F.col("p_normal") - F.col("base_normal")) + F.abs(F.col("p_anomaly") - F.col("base_anomaly"))) / 2
    x = x.withColumn("drift", F.when(F.col("_is_base"), F.lit(0.0)).otherwise(d))
    x = x.withColumn("drift_detected", ~F.col("_is_base") & (F.col("drift") > threshold))
    return x.select(SERVER, "window_id", "ts", "p_normal", "p_anomaly", "base_normal", "base_anomaly",
                    "drift", "drift_detected",
                    (F.col("drift_detected") & F.lit(bool(retrain_trigger))).alias("should_retrain"))


def in_force(df: DataFrame, versions: DataFrame, valid_from: str = "valid_from", by: str = SERVER, ts: str = "ts") -> DataFrame:
    """As-of join: ``df`` with the struct ``version``, the row of ``versions`` (``by``, ``valid_from``, …) with the latest start not after
    the row's time; null before the first one. Both are streamed once, in the order of time."""
    v = versions.select(F.col(by).alias("_by"), F.col(valid_from).alias("_at"), F.lit(0).alias("_kind"), F.struct("*").alias("version"), F.lit(None).cast(df.select(F.struct("*")).schema[0].dataType).alias("_row"))
    rows = df.select(F.col(by).alias("_by"), F.col(ts).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(v.schema["version"].dataType).alias("version"), F.struct("*").alias("_row"))
    before = Window.partitionBy("_by").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    x = v.unionByName(rows).withColumn("version", F.last("version", ignorenulls=True).over(before)).filter("_kind = 1")
    return x.select("_row.*", "version")


def drift_with_resets(df: DataFrame, resets: DataFrame, window: int = DEFAULT.drift_window, threshold: float = DEFAULT.drift_threshold,
                      retrain_trigger: bool = DEFAULT.retrain_trigger) -> DataFrame:
    """O-A10 with resets: ``resets`` (server_id, valid_from, p_normal, p_anomaly) are the baselines by their time of effect. A reset
    starts the history of predictions anew, and each prediction meets the baseline in force; where a reset has no shares, and before the
    first one, the first full window since then is the baseline and reports no drift itself."""
    x = in_force(df.select(SERVER, "window_id", "ts", "prediction"), resets).withColumn("valid_from", F.col("version.valid_from"))
    since = Window.partitionBy(SERVER, "valid_from").orderBy(*ORDER)
    fr = since.rowsBetween(-(window - 1), 0)
    share = lambda p: F.avg((F.col("prediction") == p).cast("double")).over(fr)
    x = x.select(SERVER, "window_id", "ts", "valid_from", "version", F.count(F.lit(1)).over(fr).alias("_n"), share(1).alias("p_normal"), share(-1).alias("p_anomaly")).filter(F.col("_n") == window)
    given = F.col("version.p_normal").isNotNull() & F.col("version.p_anomaly").isNotNull()
    first = since.rowsBetween(Window.unboundedPreceding, 0)
    base = lambda c: F.when(given, F.col(f"version.{c}")).otherwise(F.first(c).over(first))
    x = x.select("*", base("p_normal").alias("base_normal"), base("p_anomaly").alias("base_anomaly"), (~F.coalesce(given, F.lit(False)) & (F.row_number().over(since) == 1)).alias("_is_base"))
    d = (F.abs(F.col("p_normal") - F.col("base_normal")) + F.abs(F.col("p_anomaly") - F.col("base_anomaly"))) / 2
    x = x.withColumn("drift", F.when(F.col("_is_base"), F.lit(0.0)).otherwise(d)).withColumn("drift_detected", ~F.col("_is_base") & (F.col("drift") > threshold))
    return x.select(SERVER, "window_id", "ts", "valid_from", "p_normal", "p_anomaly", "base_normal", "base_anomaly", "drift", "drift_detected", (F.col("drift_detected") & F.lit(bool(retrain_trigger))).alias("should_retrain"))


# ---------------------------------------------------------------- risk, trend, health (A11–A16)

def risk_columns(df: DataFrame, window: int = DEFAULT.risk_window) -> DataFrame:
    """O-A11 risk score and O-A12 trend per row, from the rows up to and including it.

    risk: 0 with fewer than 3 points; else over the last ``window`` scores the sum of
    -50·s (last s < 0), -30·slope (slope < 0), min(30, 20·std_pop), 20·share(s < 0);
    capped at 100, rounded to 1 place. trend: mean(last 5) - mean(previous 5), 0 before 10 rows.
    """
    fr = _frame(-(window - 1), 0)
    rn = F.row_number().over(_ordered())
    x = df.withColumn("_rn", rn.cast("double"))
    k = F.count(F.lit(1)).over(fr)
    slope = F.regr_slope(F.col("score"), F.col("_rn")).over(fr)
    vol = F.stddev_pop("score").over(fr)
    freq = F.avg((F.col("score") < 0).cast("double")).over(fr)
    s = F.col("score")
    cur = F.when(s < 0, -s * 50).otherwise(0.0)
    trend_risk = F.when(slope < 0, -slope * 30).otherwise(0.0)
    vol_risk = F.least(F.lit(30.0), vol * 20)
    total = F.least(F.lit(100.0), cur + trend_risk + vol_risk + freq * 20)
    last5 = F.avg("score").over(_frame(-4, 0))
    prev5 = F.avg("score").over(_frame(-9, -5))
    return (x.withColumn("risk_score", F.when(k < 3, F.lit(0.0)).otherwise(F.round(total, 1)))
             .withColumn("trend", F.when(F.col("_rn") >= 10, last5 - prev5).otherwise(F.lit(0.0)))
             .drop("_rn"))


def window_activity(lines: DataFrame, keys=("server_id", "window_id"), raw: str = "raw_log") -> DataFrame:
    """O-A13: per window the error share (ERROR/FATAL lines) and the line count."""
    return lines.groupBy(*keys).agg(
        F.avg(is_error_line(raw).cast("double")).alias("error_rate"),
        F.count(F.lit(1)).alias("log_volume"))


def with_health(df: DataFrame) -> DataFrame:
    """O-A14 on a frame with score, error_rate, log_volume, trend (missing → 0)."""
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return df.withColumn("health_score", health_score(F.col("score"), z("error_rate"), z("log_volume"), z("trend")))


# ---------------------------------------------------------------- root cause (A17)

def root_cause(counts: DataFrame, templates: DataFrame | None = None, top_n: int = 5,
               keys=("server_id", "window_id")) -> DataFrame:
    """O-A17: per window the ``top_n`` events by count (> 0), ties by event id.

    Names come from the ``templates`` dimension (event_id, event_template); unknown ids are
    named ``Event_<id>``. ``row_number() <= n`` is planned as a window group limit, so
    each task keeps only its top n per window before the shuffle.
    """
    c = counts.filter(F.col("cnt") > 0)
    if templates is not None:
        # the mined table has a row per shape: an event of several shapes is named once
        names = templates.select("event_id", F.col("event_template").alias("_name")).distinct()
        c = c.join(names, "event_id", "left")
    else:
        c = c.withColumn("_name", F.lit(None).cast("string"))
    w = Window.partitionBy(*keys).orderBy(F.col("cnt").desc(), F.col("event_id"))
    return (c.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= top_n)
             .select(*keys, "rank", "event_id",
                     F.coalesce(F.col("_name"), F.concat(F.lit("Event_"), F.col("event_id"))).alias("cause"),
                     "cnt"))


def cause_lists(causes: DataFrame, keys=("server_id", "window_id"), n: int = 3) -> DataFrame:
    """Top ``n`` cause names per window as an ordered array (what an alert carries)."""
    return (causes.filter(F.col("rank") <= n)
                  .groupBy(*keys)
                  .agg(F.array_sort(F.collect_list(F.struct("rank", "cause"))).alias("_c"))
                  .select(*keys, F.transform("_c", lambda s: s["cause"]).alias("root_cause")))


# ---------------------------------------------------------------- state, history, KPIs (A18–A20)

def server_state(df: DataFrame) -> DataFrame:
    """O-A18: latest record per server (``max_by`` is a partial aggregate: skew-safe)."""
    rest = [c for c in df.columns if c != SERVER]
    latest = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in ORDER]))
    return df.groupBy(SERVER).agg(latest.alias("_s")).select(SERVER, *[F.col("_s")[c].alias(c) for c in rest])


def history_tail(df: DataFrame, n: int = DEFAULT.history_points) -> DataFrame:
    """O-A19: the last ``n`` rows per server, with ``idx`` 0 … (oldest first).

    ``row_number() <= n`` becomes a window group limit (top n per task before the shuffle).
    """
    w = _ordered(desc=True)
    x = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    cnt = F.count(F.lit(1)).over(Window.partitionBy(SERVER))
    return x.withColumn("idx", cnt - F.col("_r")).drop("_r")


def kpis(df: DataFrame) -> DataFrame:
    """O-A20: latest, mean (to 6 places), anomaly count/rate, peak and sample count per server."""
    s = F.col("score")
    n = F.count(F.lit(1))
    anomalies = F.count_if(s < 0)
    return df.groupBy(SERVER).agg(
        F.max_by(s, F.struct(*[F.col(c) for c in ORDER])).alias("latest_score"),
        mean6(s).alias("avg_score"),
        anomalies.alias("anomaly_count"),
        (anomalies / n).alias("anomaly_rate"),
        F.max(s).alias("peak_score"),
        n.alias("samples"))


# ---------------------------------------------------------------- forecast, histogram, rates (A21–A24)

def forecast(df: DataFrame, n: int = 10) -> DataFrame:
    """O-A21: least-squares line over the series index, next ``n`` values per server.

    Fewer than 3 points: the last value repeated. Output (server_id, step, forecast) with
    step = index of the forecast point (history length … + n - 1).
    """
    idx = (F.row_number().over(_ordered()) - 1).cast("double")
    x = df.select(SERVER, "score", "ts", "window_id", idx.alias("_x"))
    fit = x.groupBy(SERVER).agg(
        F.regr_slope("score", "_x").alias("slope"),
        F.regr_intercept("score", "_x").alias("intercept"),
        F.count(F.lit(1)).alias("k"),
        F.max_by("score", "_x").alias("last"))
    steps = fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    xs = F.col("k") + F.col("i")
    val = F.when(F.col("k") < 3, F.col("last")).otherwise(F.col("intercept") + F.col("slope") * xs)
    return steps.select(SERVER, xs.cast("bigint").alias("step"), val.alias("forecast"))


def score_timeline(df: DataFrame, n: int = 10) -> DataFrame:
    """O-A21: the history of each server and its forecast as one tagged series.

    Output (server_id, step, kind, score): kind ``history`` for steps 0 … length - 1, then ``forecast``."""
    past = df.select(SERVER, (F.row_number().over(_ordered()) - 1).cast("bigint").alias("step"), F.lit("history").alias("kind"), "score")
    return past.unionByName(forecast(df, n).select(SERVER, "step", F.lit("forecast").alias("kind"), F.col("forecast").alias("score")))


def score_histogram(df: DataFrame, bins: int = 10) -> DataFrame:
    """O-A22: equal-width bins between a server's min and max, right-closed, the minimum in
    bin 1; empty bins are listed with 0. Output (server_id, bin, lo, hi, cnt)."""
    rng = df.groupBy(SERVER).agg(F.min("score").alias("lo_"), F.max("score").alias("hi_"))
    x = df.select(SERVER, "score").join(rng, SERVER)
    width = F.col("hi_") - F.col("lo_")
    b = F.when(width == 0, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.ceil((F.col("score") - F.col("lo_")) / width * bins).cast("int")))
    counts = x.groupBy(SERVER, b.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    grid = rng.select(SERVER, "lo_", "hi_", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    step = (F.col("hi_") - F.col("lo_")) / bins
    return (grid.join(counts, [SERVER, "bin"], "left")
                .select(SERVER, F.col("bin").cast("bigint").alias("bin"),
                        (F.col("lo_") + (F.col("bin") - 1) * step).alias("lo"),
                        (F.col("lo_") + F.col("bin") * step).alias("hi"),
                        F.coalesce(F.col("cnt"), F.lit(0)).alias("cnt")))


def rolling_anomaly_rate(df: DataFrame, window: int = 20) -> DataFrame:
    """O-A23: share of scores < 0 over the last ``window`` rows (at least one)."""
    if not 1 <= window:
        raise ValueError("window must be positive")
    return df.withColumn("anomaly_rate",
                         F.avg((F.col("score") < 0).cast("double")).over(_frame(-(window - 1), 0)))


def top_events(structured: DataFrame, n: int = 10, event: str = "event_id") -> DataFrame:
    """O-A24: the ``n`` most frequent events (ties by id) and the total row count.

    Counting is a partial aggregate and the top-n a take-ordered over the counts; the total is
    a scalar of its own, so no task ever holds all distinct events.
    """
    total = structured.count()
    counts = structured.groupBy(F.col(event).cast("string").alias("event_id")).agg(
        F.count(F.lit(1)).alias("cnt"))
    return counts.withColumn("total_rows", F.lit(total).cast("bigint")).orderBy(F.col("cnt").desc(), F.col("event_id")).limit(n)


# ---------------------------------------------------------------- combined report (A25, A26)

def score_report(scores: DataFrame, activity: DataFrame | None = None,
                 causes: DataFrame | None = None) -> DataFrame:
    """O-A26: one row per (server, window) with score, prediction, level, risk, trend,
    health and top causes. ``activity`` carries error_rate/log_volume per window and
    ``causes`` the root_cause arrays (both optional)."""
    from ..functions.scores import alert_level, diagnosis, health_class, risk_class
    x = scores
    keys = ["server_id", "window_id"]
    if activity is not None:
        x = x.join(activity.select(*keys, "error_rate", "log_volume"), keys, "left")
    if causes is not None:
        x = x.join(causes.select(*keys, "root_cause"), keys, "left")
    x = risk_columns(x)
    x = with_health(x)
    x = x.withColumn("level", alert_level("score")).withColumn("diagnosis", diagnosis("prediction"))
    return (x.withColumn("health_class", health_class("health_score"))
             .withColumn("risk_class", risk_class("risk_score")))


def live_snapshot(scores: DataFrame, lines: DataFrame, n_lines: int = 20,
                  n_history: int = 1000) -> DataFrame:
    """O-A25: per server the latest score and diagnosis, the last ``n_lines`` log lines
    (newest first) and the indexed score history (last ``n_history``)."""
    from ..functions.scores import diagnosis
    state = server_state(scores.select(SERVER, *ORDER, "score", "prediction")).withColumn(
        "diagnosis", diagnosis("prediction"))
    lw = Window.partitionBy(SERVER).orderBy(F.col("ts").desc(), F.col("line_no").desc())
    recent = (lines.withColumn("_r", F.row_number().over(lw)).filter(F.col("_r") <= n_lines)
                   .groupBy(SERVER)
                   .agg(F.array_sort(F.collect_list(F.struct("_r", "raw_log"))).alias("_l"))
                   .select(SERVER, F.transform("_l", lambda s: s["raw_log"]).alias("recent_logs")))
    hist = (history_tail(scores.select(SERVER, *ORDER, "score"), n_history)
            .groupBy(SERVER)
            .agg(F.array_sort(F.collect_list(F.struct("idx", "score"))).alias("history")))
    return state.join(recent, SERVER, "left").join(hist, SERVER, "left")

