"""Registered queries: name → (spark_fn(spark, sf_dir) → DataFrame, oracle SQL or None).

Every query reads the driver's tables in full (or views Spark derives from them), so its
work grows with the data. Timestamps are returned as text with microseconds and floats
are rounded to 6 places (risk/health to 1 by definition) so that DuckDB can check them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import scores as S
from ..operators import alerts as A
from ..operators import features as FE
from ..operators import monitoring as M
from ..operators import sanitize as D
from ..operators import templates as TM
from ..operators import windows as W
from ..session import table
from ..sources import text as TX
from ..sources import views as V
from . import sql as Q

INGEST = dt.datetime(2024, 2, 1)
AS_OF = dt.datetime(2024, 1, 30)
TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
MODEL_VOCAB = ["click", "error", "login", "purchase", "view"]  # a model trained elsewhere


def ts_text(c) -> F.Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, TS_FMT)


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ------------------------------------------------------------------ shared inputs

def events(spark, sf):
    return table(spark, sf, "events")


def lines(spark, sf):
    return V.log_lines(events(spark, sf))


def doc_lines(spark, sf):
    return V.document_lines(table(spark, sf, "documents"))


def scores(spark, sf):
    return V.score_frame(events(spark, sf))


def clean_lines(spark, sf):
    """Masked log lines without noise: the input of template mining."""
    x = L.evaluate_once(lines(spark, sf), raw_log=L.mask_sensitive("raw_log"))
    return x.filter(~L.is_noise("raw_log"))


def minute_counts(spark, sf, seconds=60):
    ev = events(spark, sf).select(
        F.concat(F.lit("server-"), (F.col("user_id") % 8).cast("string")).alias("server_id"),
        "ts", F.col("event_type").alias("event_id"))
    return FE.feature_counts(W.time_windows(ev, seconds))


# ------------------------------------------------------------------ §2.2 row transforms

def q_mask_lines(spark, sf):
    x = doc_lines(spark, sf).filter(L.is_nonblank("line")).withColumn("line", L.strip_ws("line"))
    return x.select("doc_id", "line_idx", "line", L.mask_sensitive("line").alias("masked"))


SQL_MASK_LINES = Q.with_(Q.DOC_LINES) + f"""
select doc_id, line_idx, l as line, {Q.mask('l')} as masked
from (select doc_id, line_idx, {Q.strip('line')} as l from doc_lines) where length(l) > 0"""


def q_mask_log_lines(spark, sf):
    x = lines(spark, sf)
    return x.select("line_no", "server_id",
                    L.mask_sensitive(L.ensure_timestamp("raw_log", INGEST)).alias("masked"))


SQL_MASK_LOG_LINES = Q.with_(Q.LOG_LINES) + f"""
select line_no, server_id, {Q.mask(Q.ensure_timestamp('raw_log'))} as masked from log_lines"""


def _variants_spark(raw, ts):
    secs = F.timestamp_diff("SECOND", L.ts_lit(L.EPOCH0), F.col(ts)).cast("string")
    msg = F.substring_index(F.col(raw), " ", -1)  # last word keeps a message part
    return F.array(
        F.col(raw),
        F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" x "), msg),
        F.concat(F.date_format(ts, "MM/dd/yyyy HH:mm:ss"), F.lit(" x "), msg),
        F.concat(secs, F.lit(" x "), msg),
        F.concat(secs, F.date_format(ts, "SSS"), F.lit(" x "), msg),
        F.concat(F.lit("no time "), msg),
        F.concat(F.date_format(ts, "yyyy-"), F.lit("13"), F.date_format(ts, "-dd'T'HH:mm:ss"), F.lit(" x")),
    )


def q_event_times(spark, sf):
    x = lines(spark, sf)
    v = x.select("line_no", F.posexplode(_variants_spark("raw_log", "ts")).alias("variant", "text"))
    return v.select("line_no", F.col("variant").cast("bigint").alias("variant"), "text", ts_text(L.event_time("text", INGEST)).alias("event_ts"))


SQL_EVENT_TIMES = Q.with_(Q.LOG_LINES, """v as (
  select line_no, unnest(range(7)) as variant, unnest([
    raw_log,
    strftime(ts, '%Y-%m-%d %H:%M:%S') || ' x ' || split_part(raw_log, ' ', -1),
    strftime(ts, '%m/%d/%Y %H:%M:%S') || ' x ' || split_part(raw_log, ' ', -1),
    cast(epoch_us(ts) // 1000000 as varchar) || ' x ' || split_part(raw_log, ' ', -1),
    cast(epoch_us(ts) // 1000000 as varchar) || strftime(ts, '%g') || ' x ' || split_part(raw_log, ' ', -1),
    'no time ' || split_part(raw_log, ' ', -1),
    strftime(ts, '%Y-') || '13' || strftime(ts, '-%dT%H:%M:%S') || ' x']) as text
  from log_lines)""") + f"""
select line_no, variant, text, {Q.ts_text(Q.event_time('text'))} as event_ts from v"""


def q_noise_filtered(spark, sf):
    x = lines(spark, sf)
    return x.filter(~L.is_noise("raw_log")).select("line_no", "server_id", "raw_log")


SQL_NOISE_FILTERED = Q.with_(Q.LOG_LINES) + f"""
select line_no, server_id, raw_log from log_lines where not {Q.is_noise('raw_log')}"""


def q_line_display(spark, sf):
    x = lines(spark, sf)
    return x.select("line_no", L.is_error_line("raw_log").alias("is_error"),
                    L.display_flag("raw_log").alias("flagged"),
                    L.display_time("raw_log").alias("time_token"),
                    L.display_message("raw_log").alias("message"))


SQL_LINE_DISPLAY = Q.with_(Q.LOG_LINES) + """
select line_no, (contains(raw_log, 'ERROR') or contains(raw_log, 'FATAL')) as is_error,
       (contains(raw_log, 'ERROR') or contains(raw_log, 'Attack')) as flagged,
       case when contains(raw_log, ' ') then split_part(raw_log, ' ', 2) end as time_token,
       substr(raw_log, instr(raw_log, ' ') + 1) as message
from log_lines"""


# ------------------------------------------------------------------ §2.1 lenient CSV, append

def _csv_text(spark, sf):
    """Comma-joined rows from documents lines (prose has commas) in 4-, 3-, 2- and 1-field shapes."""
    d = doc_lines(spark, sf).filter(L.is_nonblank("line"))
    shape = F.col("line_idx") % 4
    txt = (F.when(shape == 0, F.concat_ws(",", "line", F.col("doc_id").cast("string"), "source", F.lit("2024-01-02T03:04:05")))
            .when(shape == 1, F.concat_ws(",", "line", F.col("doc_id").cast("string"), "source"))
            .when(shape == 2, F.concat_ws(",", "line", F.col("doc_id").cast("string")))
            .otherwise(F.col("line")))
    return d.select("doc_id", "line_idx", txt.alias("value"))


def q_lenient_csv(spark, sf):
    return TX.parse_lenient(_csv_text(spark, sf)).select(
        "doc_id", "line_idx", "raw_log", "event_id", "event_template", "ts_text")


SQL_LENIENT_CSV = Q.with_(Q.DOC_LINES, f"""t as (
  select doc_id, line_idx, case line_idx % 4
    when 0 then concat_ws(',', line, cast(doc_id as varchar), source, '2024-01-02T03:04:05')
    when 1 then concat_ws(',', line, cast(doc_id as varchar), source)
    when 2 then concat_ws(',', line, cast(doc_id as varchar))
    else line end as value
  from doc_lines where length({Q.strip('line')}) > 0),
p as (select doc_id, line_idx, string_split(value, ',') as parts, len(string_split(value, ',')) as k from t)""") + """
select doc_id, line_idx,
  case when k >= 4 then array_to_string(parts[1:k-3], ',') else parts[1] end as raw_log,
  case when k >= 4 then parts[k-2] when k >= 2 then parts[2] else '' end as event_id,
  case when k >= 4 then parts[k-1] when k >= 3 then parts[3] else '' end as event_template,
  case when k >= 4 then parts[k] else '' end as ts_text
from p"""


def _structured(spark, sf):
    x = lines(spark, sf)
    return x.select("raw_log", F.col("line_no").cast("string").alias("event_id"),
                    F.lit("unknown").alias("event_template"), ts_text("ts").alias("ts"))


def q_append_dedup(spark, sf):
    x = _structured(spark, sf)
    existing = x.filter(F.col("ts") < "2024-01-19")
    new = x.filter(F.col("ts") >= "2024-01-12")
    existing = existing.unionByName(existing.filter(F.col("ts") >= "2024-01-18"))  # duplicates in the target
    return TX.union_dedup(existing, new)


SQL_APPEND_DEDUP = Q.with_(Q.LOG_LINES, f"""x as (select raw_log, cast(line_no as varchar) as event_id,
  'unknown' as event_template, {Q.ts_text('ts')} as ts from log_lines)""") + """
select * from x where ts < '2024-01-19' union select * from x where ts >= '2024-01-12'"""


# ------------------------------------------------------------------ §2.3 templates

def q_signatures(spark, sf):
    return TM.signatures(clean_lines(spark, sf))


SQL_SIGNATURES = Q.with_(Q.LOG_LINES, Q.CLEAN, Q.SIGNED) + """
select n_tokens, first_token, signature, count(*) as support from signed group by 1, 2, 3"""


def q_doc_signatures(spark, sf):
    d = doc_lines(spark, sf).filter(L.is_nonblank("line"))
    return TM.signatures(d.withColumn("raw_log", L.mask_sensitive("line")))


SQL_DOC_SIGNATURES = Q.with_(Q.DOC_LINES, f"""clean as (select {Q.mask('line')} as raw_log from doc_lines
  where length({Q.strip('line')}) > 0)""", Q.SIGNED) + """
select n_tokens, first_token, signature, count(*) as support from signed group by 1, 2, 3"""


def q_templates(spark, sf):
    return TM.mine_templates(TM.signatures(clean_lines(spark, sf)))


SQL_TEMPLATES = Q.with_(Q.LOG_LINES, Q.CLEAN, Q.SIGNED, Q.MINED) + """
select n_tokens, first_token, signature, count(*) as support, event_template, event_id
from assigned group by n_tokens, first_token, signature, event_template, event_id"""


def q_doc_templates(spark, sf):
    d = doc_lines(spark, sf).filter(L.is_nonblank("line")).withColumn("raw_log", L.mask_sensitive("line"))
    return TM.mine_templates(TM.signatures(d))


def q_assigned_templates(spark, sf):
    a, _ = TM.mine_and_assign(clean_lines(spark, sf))
    return a.select("line_no", "server_id", "raw_log", "event_id", "event_template")


SQL_ASSIGNED_TEMPLATES = Q.with_(Q.LOG_LINES, Q.CLEAN, Q.SIGNED, Q.MINED) + """
select line_no, server_id, raw_log, event_id, event_template from assigned"""


# ------------------------------------------------------------------ §2.4 sanitise

def q_sanitized(spark, sf):
    d = doc_lines(spark, sf).select("doc_id", "line_idx", F.col("line").alias("raw_log"),
                                    F.col("source").alias("event_id"))
    s = D.sanitize(d, INGEST)
    first = D.dedupe_first(s, order=("doc_id", "line_idx"))
    return first.select("raw_log", "event_id", "event_template", "doc_id", "line_idx", ts_text("ts").alias("ts"))


SQL_SANITIZED = Q.with_(Q.DOC_LINES) + f"""
select raw_log, event_id, 'unknown' as event_template, doc_id, line_idx, '2024-02-01 00:00:00.000000' as ts from (
  select line as raw_log, source as event_id, doc_id, line_idx,
         row_number() over (partition by line, source order by doc_id, line_idx) as rn
  from doc_lines where length({Q.strip('line')}) > 0) where rn = 1"""


def q_distinct_lines(spark, sf):
    d = doc_lines(spark, sf).select(F.col("line").alias("raw_log"), F.col("source").alias("event_id"))
    return D.distinct_all(d)


SQL_DISTINCT_LINES = Q.with_(Q.DOC_LINES) + "select distinct line as raw_log, source as event_id from doc_lines"


# ------------------------------------------------------------------ §2.5 windows and features

def q_time_window_counts(spark, sf):
    return minute_counts(spark, sf)


SQL_TIME_WINDOW_COUNTS = Q.with_(Q.MINUTE_COUNTS) + "select * from counts"


def q_line_window_counts(spark, sf):
    ev = events(spark, sf).select(
        F.concat(F.lit("server-"), (F.col("user_id") % 8).cast("string")).alias("server_id"),
        F.col("event_id").alias("line_no"), F.col("event_type").alias("event_id"))
    return FE.feature_counts(W.line_windows(ev, 100))


SQL_LINE_WINDOW_COUNTS = """
select 'server-' || cast(user_id % 8 as varchar) as server_id, event_id // 100 as window_id,
       event_type as event_id, count(*) as cnt from events group by 1, 2, 3"""


def q_feature_matrix(spark, sf):
    return FE.feature_matrix(minute_counts(spark, sf))


SQL_FEATURE_MATRIX = Q.with_(Q.MINUTE_COUNTS) + """
select server_id, window_id,
  cast(sum(case when event_id = 'click' then cnt else 0 end) as bigint) as click,
  cast(sum(case when event_id = 'error' then cnt else 0 end) as bigint) as error,
  cast(sum(case when event_id = 'purchase' then cnt else 0 end) as bigint) as purchase,
  cast(sum(case when event_id = 'signup' then cnt else 0 end) as bigint) as signup,
  cast(sum(case when event_id = 'view' then cnt else 0 end) as bigint) as view
from counts group by 1, 2"""


def q_aligned_features(spark, sf):
    return FE.aligned_long(minute_counts(spark, sf), MODEL_VOCAB)


_VOCAB_SQL = "(select unnest(range(5)) as idx, unnest(['click', 'error', 'login', 'purchase', 'view']) as event_id)"

SQL_ALIGNED_FEATURES = Q.with_(Q.MINUTE_COUNTS) + f"""
select w.server_id, w.window_id, v.idx, v.event_id, coalesce(c.cnt, 0) as cnt
from (select distinct server_id, window_id from counts) w cross join {_VOCAB_SQL} v
left join counts c on c.server_id = w.server_id and c.window_id = w.window_id and c.event_id = v.event_id"""


def q_latest_window(spark, sf):
    return FE.latest_window(minute_counts(spark, sf))


SQL_LATEST_WINDOW = Q.with_(Q.MINUTE_COUNTS) + """
select c.* from counts c join (select server_id, max(window_id) as w from counts group by 1) l
  on c.server_id = l.server_id and c.window_id = l.w"""


def q_scaler_fit(spark, sf):
    from ..operators.scaler import fit_scaler
    s = fit_scaler(minute_counts(spark, sf))
    return s.select("event_id", r6("mean").alias("mean"), r6("scale").alias("scale"))


SQL_SCALER = """s as (
  select c.event_id, sum(c.cnt) / n.n as mean,
         greatest(0, sum(c.cnt * c.cnt) / n.n - (sum(c.cnt) / n.n) * (sum(c.cnt) / n.n)) as var
  from counts c, (select count(*) as n from (select distinct server_id, window_id from counts)) n
  group by c.event_id, n.n),
sc as (select event_id, mean, case when sqrt(var) = 0 then 1.0 else sqrt(var) end as scale from s)"""

SQL_SCALER_FIT = Q.with_(Q.MINUTE_COUNTS, SQL_SCALER) + "select event_id, 0.0 + round(mean, 6) as mean, 0.0 + round(scale, 6) as scale from sc"


def q_scaled_features(spark, sf):
    from ..operators.scaler import fit_scaler, scale_long
    c = minute_counts(spark, sf)
    s = fit_scaler(c)
    return scale_long(c, s).select("server_id", "window_id", "event_id", r6("value").alias("value"))


SQL_SCALED_FEATURES = Q.with_(Q.MINUTE_COUNTS, SQL_SCALER) + """
select w.server_id, w.window_id, sc.event_id, 0.0 + round((coalesce(c.cnt, 0) - sc.mean) / sc.scale, 6) as value
from (select distinct server_id, window_id from counts) w cross join sc
left join counts c on c.server_id = w.server_id and c.window_id = w.window_id and c.event_id = sc.event_id"""


# ------------------------------------------------------------------ §2.6 model arithmetic (closed form)

def _model_inputs(spark, sf):
    c = minute_counts(spark, sf)
    per = c.groupBy("server_id", "window_id").agg(
        F.sum("cnt").alias("n"), F.sum(F.when(F.col("event_id") == "error", F.col("cnt")).otherwise(0)).alias("err"))
    return per.select("server_id", "window_id",
                      (F.lit(0.1) - F.col("err") / F.col("n")).alias("if_score"),
                      (F.col("err") * F.col("err") / F.col("n")).cast("double").alias("mse"))


def q_ensemble_scores(spark, sf):
    from ..operators.ensemble import ae_scores_from_mse, ensemble
    x = ae_scores_from_mse(_model_inputs(spark, sf))
    e = ensemble(x)
    return e.select("server_id", "window_id", r6("if_score").alias("if_score"), r6("ae_score").alias("ae_score"),
                    "ae_prediction", r6("score").alias("score"), "prediction")


SQL_MODEL_INPUTS = Q.MINUTE_COUNTS + """,
per as (select server_id, window_id, sum(cnt) as n, sum(case when event_id = 'error' then cnt else 0 end) as err
        from counts group by 1, 2),
mi as (select server_id, window_id, 0.1 - err / n as if_score, cast(err * err / n as double) as mse from per),
th as (select quantile_cont(mse, 0.95) as thr from mi),
ae as (select mi.*, case when thr > 0 then 0.0 - mse / thr else 0.0 - mse end as ae_score,
              case when mse > thr then -1 else 1 end as ae_prediction from mi, th),
en as (select *, 0.6 * tanh(if_score) + 0.4 * tanh(ae_score) as score from ae)"""

SQL_ENSEMBLE_SCORES = "with " + SQL_MODEL_INPUTS + """
select server_id, window_id, 0.0 + round(if_score, 6) as if_score, 0.0 + round(ae_score, 6) as ae_score, ae_prediction,
       0.0 + round(score, 6) as score, case when score < 0 then -1 else 1 end as prediction from en"""


def q_ae_threshold(spark, sf):
    """O-M5 arithmetic: 95th percentile threshold of the errors, score and prediction."""
    from ..operators.ensemble import ae_scores_from_mse
    x = ae_scores_from_mse(_model_inputs(spark, sf))
    return x.select("server_id", "window_id", r6("mse").alias("mse"), r6("ae_threshold").alias("threshold"),
                    r6("ae_score").alias("ae_score"), "ae_prediction")


def q_ensemble_without_ae(spark, sf):
    from ..operators.ensemble import ensemble
    x = _model_inputs(spark, sf)
    e = ensemble(x, with_ae=False)
    return e.select("server_id", "window_id", r6("score").alias("score"), "prediction",
                    "ae_prediction", r6("ae_score").alias("ae_score"))


SQL_AE_THRESHOLD = "with " + SQL_MODEL_INPUTS + """
select server_id, window_id, 0.0 + round(mse, 6) as mse, 0.0 + round(thr, 6) as threshold, 0.0 + round(ae_score, 6) as ae_score,
       ae_prediction from ae, th"""

SQL_ENSEMBLE_WITHOUT_AE = "with " + SQL_MODEL_INPUTS + """
select server_id, window_id, 0.0 + round(0.6 * tanh(if_score), 6) as score,
       case when 0.6 * tanh(if_score) < 0 then -1 else 1 end as prediction, 1 as ae_prediction, cast(0.0 as double) as ae_score from mi"""


def q_model_breakdown(spark, sf):
    from ..operators.ensemble import ae_scores_from_mse, breakdown, ensemble
    b = breakdown(ensemble(ae_scores_from_mse(_model_inputs(spark, sf))))
    return b.select("server_id", "window_id", "model", "model_prediction", r6("model_score").alias("model_score"),
                    "weight", "label")


SQL_MODEL_BREAKDOWN = "with " + SQL_MODEL_INPUTS + """
select server_id, window_id, 'isolation_forest' as model, case when if_score < 0 then -1 else 1 end as model_prediction,
       0.0 + round(if_score, 6) as model_score, cast(0.6 as double) as weight,
       case when if_score < 0 then 'Anomaly' else 'Normal' end as label from en
union all
select server_id, window_id, 'autoencoder', ae_prediction, 0.0 + round(ae_score, 6), cast(0.4 as double),
       case when ae_prediction = -1 then 'Anomaly' else 'Normal' end from en
union all
select server_id, window_id, 'ensemble', case when score < 0 then -1 else 1 end, 0.0 + round(score, 6), cast(1.0 as double),
       case when score < 0 then 'Anomaly' else 'Normal' end from en"""


# ------------------------------------------------------------------ §2.7 monitoring on score_series

def q_alert_levels(spark, sf):
    s = scores(spark, sf)
    return s.select("server_id", "window_id", ts_text("ts").alias("ts"), "score",
                    S.alert_level("score").alias("level"), S.risk_level("score").alias("risk_level"))


SQL_ALERT_LEVELS = Q.with_(Q.SCORES) + f"""
select server_id, window_id, {Q.ts_text('ts')} as ts, score, {Q.level('score')} as level,
       {Q.level('score', 'LOW')} as risk_level from scores"""


def q_risk_levels(spark, sf):
    """O-A2: risk level per score (thresholds as for alerts, LOW when none applies)."""
    s = scores(spark, sf)
    bounds = A.threshold_table(spark).select(F.col("level").alias("risk_level"), F.col("rank").cast("bigint").alias("severity"),
                                             F.col("upper_bound").alias("bound"))  # four rows
    x = s.select("server_id", "window_id", "score", S.risk_level("score").alias("risk_level"))
    return x.join(F.broadcast(bounds), "risk_level")


SQL_RISK_LEVELS = Q.with_(Q.SCORES) + f"""
select server_id, window_id, score, risk_level, severity, bound
from (select server_id, window_id, score, {Q.level('score', 'LOW')} as risk_level from scores) join
  (select unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW']) as risk_level, unnest([0, 1, 2, 3])::bigint as severity,
          unnest([-0.9, -0.7, -0.5, -0.3])::double as bound) using (risk_level)"""


def _alerts(spark, sf, throttle=300, suppress=3600):
    return A.generate_alerts(scores(spark, sf), throttle, suppress)


def _alert_cols(a):
    return a.select("server_id", "window_id", ts_text("ts").alias("ts"), "score", "level", "decision",
                    "suppressed", "message")


def q_alerts(spark, sf):
    return _alert_cols(_alerts(spark, sf))


def q_alerts_long_suppress(spark, sf):
    return _alert_cols(_alerts(spark, sf, 43200, 172800))


_ALERT_SELECT = f"select server_id, window_id, {Q.ts_text('ts')} as ts, score, level, decision, suppressed, message from alerts"
SQL_ALERTS = Q.recursive_alerts(300, 3600) + _ALERT_SELECT
SQL_ALERTS_LONG = Q.recursive_alerts(43200, 172800) + _ALERT_SELECT


def q_recent_alerts(spark, sf):
    return _alert_cols(A.recent_alerts(_alerts(spark, sf, 43200, 172800), 50, "HIGH"))


SQL_RECENT_ALERTS = Q.recursive_alerts(43200, 172800) + f"""
select * from ({_ALERT_SELECT} order by ts desc, server_id desc limit 50) where level = 'HIGH'"""


def q_alert_stats(spark, sf):
    return A.alert_stats(_alerts(spark, sf, 43200, 172800), AS_OF)


SQL_ALERT_STATS = Q.recursive_alerts(43200, 172800) + f"""
select level, count(*) as alerts,
       count(*) filter (where epoch_us(timestamp '{Q.AS_OF}') - epoch_us(ts) < 86400000000) as recent_24h
from alerts group by rollup (level)"""


def q_drift(spark, sf):
    d = M.drift(scores(spark, sf), window=40)
    return d.select("server_id", "window_id", r6("p_normal").alias("p_normal"), r6("p_anomaly").alias("p_anomaly"),
                    r6("drift").alias("drift"), "drift_detected", "should_retrain")


SQL_DRIFT = Q.with_(Q.SCORES, """d as (
  select server_id, window_id, ts,
    count(*) over w as n,
    avg(case when prediction = 1 then 1.0 else 0.0 end) over w as p_normal,
    avg(case when prediction = -1 then 1.0 else 0.0 end) over w as p_anomaly
  from scores window w as (partition by server_id order by ts, window_id rows between 39 preceding and current row)),
f as (select *, row_number() over (partition by server_id order by ts, window_id) as rn,
    first_value(p_normal) over (partition by server_id order by ts, window_id) as bn,
    first_value(p_anomaly) over (partition by server_id order by ts, window_id) as ba
  from d where n = 40)""") + """
select server_id, window_id, 0.0 + round(p_normal, 6) as p_normal, 0.0 + round(p_anomaly, 6) as p_anomaly,
  0.0 + round(case when rn = 1 then 0.0 else (abs(p_normal - bn) + abs(p_anomaly - ba)) / 2 end, 6) as drift,
  rn > 1 and (abs(p_normal - bn) + abs(p_anomaly - ba)) / 2 > 0.15 as drift_detected,
  rn > 1 and (abs(p_normal - bn) + abs(p_anomaly - ba)) / 2 > 0.15 as should_retrain
from f"""


def q_drift_baseline(spark, sf):
    d = M.prediction_distribution(scores(spark, sf))
    return d.select("server_id", r6("p_normal").alias("p_normal"), r6("p_anomaly").alias("p_anomaly"))


SQL_DRIFT_BASELINE = Q.with_(Q.SCORES) + """
select server_id, 0.0 + round(coalesce(avg(case when prediction = 1 then 1.0 else 0.0 end), 0), 6) as p_normal,
  0.0 + round(coalesce(avg(case when prediction = -1 then 1.0 else 0.0 end), 0), 6) as p_anomaly
from scores group by 1"""


def q_drift_vs_baseline(spark, sf):
    """Drift of the last 40 predictions against a baseline table taken from each server's
    first 60 windows (a retrain / reset sets a new baseline table)."""
    from pyspark.sql import Window
    s = scores(spark, sf)
    first = s.withColumn("_r", F.row_number().over(Window.partitionBy("server_id").orderBy("ts", "window_id")))
    base = M.prediction_distribution(first.filter(F.col("_r") <= 60))
    d = M.drift(s, window=40, baseline=base)
    return d.select("server_id", "window_id", r6("drift").alias("drift"), "drift_detected")


SQL_DRIFT_VS_BASELINE = Q.with_(Q.SCORES, """b as (select server_id,
    avg(case when prediction = 1 then 1.0 else 0.0 end) as bn, avg(case when prediction = -1 then 1.0 else 0.0 end) as ba
  from (select *, row_number() over (partition by server_id order by ts, window_id) as r from scores) where r <= 60
  group by 1),
d as (select server_id, window_id, count(*) over w as n,
    avg(case when prediction = 1 then 1.0 else 0.0 end) over w as pn,
    avg(case when prediction = -1 then 1.0 else 0.0 end) over w as pa
  from scores window w as (partition by server_id order by ts, window_id rows between 39 preceding and current row))""") + """
select server_id, window_id, 0.0 + round((abs(pn - bn) + abs(pa - ba)) / 2, 6) as drift,
  (abs(pn - bn) + abs(pa - ba)) / 2 > 0.15 as drift_detected
from d join b using (server_id) where n = 40"""


def q_drift_resets(spark, sf):
    """O-A10 with versions: every server is reset on 11 January to the shares of the days before, and on the 21st to none."""
    s = scores(spark, sf)
    at = lambda d: F.lit(d).cast("timestamp_ntz").alias("valid_from")
    first = M.prediction_distribution(s.filter(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"))).select("server_id", at("2024-01-11"), "p_normal", "p_anomaly")
    second = s.select("server_id").distinct().select("server_id", at("2024-01-21"), F.lit(None).cast("double").alias("p_normal"), F.lit(None).cast("double").alias("p_anomaly"))
    d = M.drift_with_resets(s, first.unionByName(second), window=20)
    return d.select("server_id", "window_id", ts_text("valid_from").alias("valid_from"), r6("base_normal").alias("base_normal"), r6("drift").alias("drift"), "drift_detected", "should_retrain")


SQL_DRIFT_RESETS = Q.with_(Q.SCORES, """resets as (
  select server_id, timestamp '2024-01-11' as valid_from, avg(case when prediction = 1 then 1.0 else 0.0 end) as bn,
    avg(case when prediction = -1 then 1.0 else 0.0 end) as ba from scores where ts < timestamp '2024-01-11' group by 1
  union all select distinct server_id, timestamp '2024-01-21', cast(null as double), cast(null as double) from scores),
p as (select s.*, r.valid_from, r.bn, r.ba from scores s asof left join resets r on s.server_id = r.server_id and s.ts >= r.valid_from),
d as (select server_id, window_id, ts, valid_from, bn, ba, count(*) over w as n,
    avg(case when prediction = 1 then 1.0 else 0.0 end) over w as pn, avg(case when prediction = -1 then 1.0 else 0.0 end) over w as pa
  from p window w as (partition by server_id, valid_from order by ts, window_id rows between 19 preceding and current row)),
f as (select *, row_number() over o as rn, coalesce(bn, first_value(pn) over o) as b1, coalesce(ba, first_value(pa) over o) as b2
  from d where n = 20 window o as (partition by server_id, valid_from order by ts, window_id)),
x as (select *, bn is null and rn = 1 as is_base, (abs(pn - b1) + abs(pa - b2)) / 2 as dr from f)""") + f"""
select server_id, window_id, {Q.ts_text('valid_from')} as valid_from, 0.0 + round(b1, 6) as base_normal,
  0.0 + round(case when is_base then 0.0 else dr end, 6) as drift, not is_base and dr > 0.15 as drift_detected,
  not is_base and dr > 0.15 as should_retrain from x"""


def _activity(spark, sf):
    x = W.epoch_windows(lines(spark, sf), 21600)
    return M.window_activity(x)


def q_risk_scores(spark, sf):
    r = M.risk_columns(scores(spark, sf))
    return r.select("server_id", "window_id", "risk_score", r6("trend").alias("trend"),
                    S.risk_class("risk_score").alias("risk_class"))


SQL_RISK = """r as (
  select server_id, window_id, ts, score, prediction,
    row_number() over o as rn,
    count(*) over w10 as k,
    regr_slope(score, rn_d) over w10 as slope,
    stddev_pop(score) over w10 as vol,
    avg(case when score < 0 then 1.0 else 0.0 end) over w10 as freq,
    avg(score) over (partition by server_id order by ts, window_id rows between 4 preceding and current row) as last5,
    avg(score) over (partition by server_id order by ts, window_id rows between 9 preceding and 5 preceding) as prev5
  from (select *, cast(row_number() over (partition by server_id order by ts, window_id) as double) as rn_d from scores)
  window o as (partition by server_id order by ts, window_id),
         w10 as (partition by server_id order by ts, window_id rows between 9 preceding and current row)),
rk as (select *,
    case when k < 3 then 0.0 else 0.0 + round(least(100.0,
      (case when score < 0 then -score * 50 else 0 end)
      + (case when slope < 0 then -slope * 30 else 0 end)
      + least(30.0, vol * 20) + freq * 20), 1) end as risk_score,
    case when rn >= 10 then last5 - prev5 else 0.0 end as trend
  from r)"""

SQL_RISK_SCORES = Q.with_(Q.SCORES, SQL_RISK) + """
select server_id, window_id, risk_score, 0.0 + round(trend, 6) as trend,
  case when risk_score < 30 then 'good' when risk_score < 60 then 'warning' else 'critical' end as risk_class from rk"""


def q_trend(spark, sf):
    """O-A12: mean of the last 5 scores minus the mean of the 5 before (0 before 10 rows)."""
    r = M.risk_columns(scores(spark, sf))
    return r.select("server_id", "window_id", r6("trend").alias("trend"))


def q_health(spark, sf):
    x = scores(spark, sf).join(_activity(spark, sf), ["server_id", "window_id"], "left")
    h = M.with_health(M.risk_columns(x))
    return h.select("server_id", "window_id", r6("error_rate").alias("error_rate"), "log_volume",
                    "health_score", S.health_class("health_score").alias("health_class"),
                    S.diagnosis("prediction").alias("diagnosis"))


SQL_TREND = Q.with_(Q.SCORES, SQL_RISK) + "select server_id, window_id, 0.0 + round(trend, 6) as trend from rk"

SQL_ACTIVITY = Q.LOG_LINES + """,
act as (select server_id, cast(epoch_us(ts) // 21600000000 as bigint) as window_id,
  avg(case when contains(raw_log, 'ERROR') or contains(raw_log, 'FATAL') then 1.0 else 0.0 end) as error_rate,
  count(*) as log_volume from log_lines group by 1, 2)"""

SQL_HEALTH_CORE = """hs as (select rk.*, act.error_rate, act.log_volume,
  0.0 + round(greatest(0, least(100,
    0.4 * greatest(0, least(100, (score + 1) * 50))
    + 0.3 * greatest(0, least(100, (1 - coalesce(act.error_rate, 0)) * 100))
    + 0.2 * greatest(0, least(100, 100 - coalesce(act.log_volume, 0) / 10))
    + 0.1 * greatest(0, least(100, 50 + trend * 25)))), 1) as health_score
  from rk left join act using (server_id, window_id))"""

SQL_HEALTH = Q.with_(Q.SCORES, SQL_RISK, SQL_ACTIVITY, SQL_HEALTH_CORE) + """
select server_id, window_id, 0.0 + round(error_rate, 6) as error_rate, log_volume, health_score,
  case when health_score >= 70 then 'good' when health_score >= 50 then 'warning' else 'critical' end as health_class,
  case when prediction = -1 then 'CRITICAL' else 'Healthy' end as diagnosis from hs"""


def _template_counts(spark, sf, seconds=None):
    """(server_id, window_id, event_id, cnt) of mined templates, plus the templates table."""
    a, t = TM.mine_and_assign(clean_lines(spark, sf))
    w = W.epoch_windows(a, 21600) if seconds is None else W.time_windows(a, seconds)
    return FE.feature_counts(w), t


def q_root_cause(spark, sf):
    counts, t = _template_counts(spark, sf, 3600)
    return M.root_cause(counts, t, top_n=5)


SQL_ROOT_CAUSE = Q.with_(Q.LOG_LINES, Q.CLEAN, Q.SIGNED, Q.MINED, """t0 as (select min(ts) as t0 from signed),
cc as (select server_id, cast((epoch_us(ts) - epoch_us(t0)) // 3600000000 as bigint) as window_id,
  event_id, event_template as cause, count(*) as cnt from assigned, t0 group by all)""") + """
select * from (select server_id, window_id,
  row_number() over (partition by server_id, window_id order by cnt desc, event_id) as rank, event_id, cause, cnt from cc)
where rank <= 5"""


def q_server_state(spark, sf):
    st = M.server_state(scores(spark, sf))
    return st.select("server_id", "window_id", ts_text("ts").alias("ts"), "score", "prediction", "n_events")


SQL_SERVER_STATE = Q.with_(Q.SCORES) + f"""
select server_id, arg_max(window_id, ts) as window_id, {Q.ts_text('max(ts)')} as ts, arg_max(score, ts) as score,
  arg_max(prediction, ts) as prediction, arg_max(n_events, ts) as n_events from scores group by 1"""


def q_history_tail(spark, sf):
    h = M.history_tail(scores(spark, sf), 50)
    return h.select("server_id", "idx", "window_id", "score")


SQL_HISTORY_TAIL = Q.with_(Q.SCORES) + """
select server_id, cast(count(*) over (partition by server_id) - r as bigint) as idx, window_id, score from (
  select *, row_number() over (partition by server_id order by ts desc, window_id desc) as r from scores) where r <= 50"""


def q_kpis(spark, sf):
    k = M.kpis(scores(spark, sf))
    return k.select("server_id", "latest_score", "avg_score", "anomaly_count",
                    r6("anomaly_rate").alias("anomaly_rate"), "peak_score", "samples")


SQL_KPIS = Q.with_(Q.SCORES) + """
select server_id, arg_max(score, ts) as latest_score,
  sign(sum(micro)) * ((2 * abs(sum(micro)) + count(*)) // (2 * count(*))) / 1000000.0::double + 0.0 as avg_score,
  count(*) filter (where score < 0) as anomaly_count, 0.0 + round(count(*) filter (where score < 0) / count(*), 6) as anomaly_rate,
  max(score) as peak_score, count(*) as samples
from (select *, cast(round(score * 1000000) as bigint) as micro from scores) group by 1"""


def q_forecast(spark, sf):
    """O-A21: history and forecast of every server in one tagged series."""
    f = M.score_timeline(scores(spark, sf), 10)
    return f.select("server_id", "step", "kind", r6("score").alias("score"))


SQL_FORECAST = Q.with_(Q.SCORES, """x as (select server_id, score,
  cast(row_number() over (partition by server_id order by ts, window_id) - 1 as double) as x from scores),
fit as (select server_id, regr_slope(score, x) as slope, regr_intercept(score, x) as icp, count(*) as k,
  arg_max(score, x) as last from x group by 1)""") + """
select server_id, cast(k + i as bigint) as step, 'forecast' as kind,
  0.0 + round(case when k < 3 then last else icp + slope * (k + i) end, 6) as score
from fit, (select unnest(range(10)) as i)
union all
select server_id, cast(x as bigint), 'history', 0.0 + round(score, 6) from x"""


def q_score_histogram(spark, sf):
    h = M.score_histogram(scores(spark, sf), 10)
    return h.select("server_id", "bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "cnt")


SQL_SCORE_HISTOGRAM = Q.with_(Q.SCORES, """rg as (select server_id, min(score) as lo_, max(score) as hi_ from scores group by 1),
b as (select s.server_id, case when hi_ - lo_ = 0 then 1
        else greatest(1, cast(ceil((score - lo_) / (hi_ - lo_) * 10) as int)) end as bin
      from scores s join rg using (server_id)),
bc as (select server_id, bin, count(*) as cnt from b group by 1, 2)""") + """
select g.server_id, g.bin, 0.0 + round(lo_ + (g.bin - 1) * ((hi_ - lo_) / 10), 6) as lo,
  0.0 + round(lo_ + g.bin * ((hi_ - lo_) / 10), 6) as hi, coalesce(bc.cnt, 0) as cnt
from (select server_id, lo_, hi_, unnest(range(1, 11)) as bin from rg) g
left join bc on bc.server_id = g.server_id and bc.bin = g.bin"""


def q_rolling_rate(spark, sf):
    r = M.rolling_anomaly_rate(scores(spark, sf), 20)
    return r.select("server_id", "window_id", r6("anomaly_rate").alias("anomaly_rate"))


SQL_ROLLING_RATE = Q.with_(Q.SCORES) + """
select server_id, window_id, 0.0 + round(avg(case when score < 0 then 1.0 else 0.0 end) over
  (partition by server_id order by ts, window_id rows between 19 preceding and current row), 6) as anomaly_rate from scores"""


def q_top_events(spark, sf):
    d = doc_lines(spark, sf).filter(L.is_nonblank("line")).withColumn("raw_log", L.mask_sensitive("line"))
    s = TM.with_signature(d).withColumn("event_id", TM.event_id_of("signature"))
    return M.top_events(s, 10)


SQL_TOP_EVENTS = Q.with_(Q.DOC_LINES, f"""clean as (select {Q.mask('line')} as raw_log from doc_lines
  where length({Q.strip('line')}) > 0)""", Q.SIGNED, """c as (select substr(md5(signature), 1, 16) as event_id, count(*) as cnt
  from signed group by 1)""") + """
select event_id, cnt, cast(sum(cnt) over () as bigint) as total_rows from c order by cnt desc, event_id limit 10"""


def q_score_report(spark, sf):
    counts, t = _template_counts(spark, sf)
    causes = M.cause_lists(M.root_cause(counts, t, top_n=5), n=3)
    r = M.score_report(scores(spark, sf), _activity(spark, sf), causes)
    return r.select("server_id", "window_id", ts_text("ts").alias("ts"), "score", "prediction", "level",
                    "risk_score", r6("trend").alias("trend"), "health_score", "health_class", "risk_class",
                    "diagnosis", F.array_join("root_cause", " | ").alias("root_cause"))


SQL_SCORE_REPORT = Q.with_(Q.SCORES, SQL_RISK, SQL_ACTIVITY, SQL_HEALTH_CORE, Q.CLEAN, Q.SIGNED, Q.MINED, """cc as (
  select server_id, cast(epoch_us(ts) // 21600000000 as bigint) as window_id, event_id,
         event_template as cause, count(*) as cnt from assigned group by all),
rc as (select server_id, window_id, string_agg(cause, ' | ' order by rank) as root_cause from (
  select *, row_number() over (partition by server_id, window_id order by cnt desc, event_id) as rank from cc)
  where rank <= 3 group by 1, 2)""") + f"""
select hs.server_id, hs.window_id, {Q.ts_text('ts')} as ts, score, prediction, {Q.level('score')} as level,
  risk_score, 0.0 + round(trend, 6) as trend, health_score,
  case when health_score >= 70 then 'good' when health_score >= 50 then 'warning' else 'critical' end as health_class,
  case when risk_score < 30 then 'good' when risk_score < 60 then 'warning' else 'critical' end as risk_class,
  case when prediction = -1 then 'CRITICAL' else 'Healthy' end as diagnosis, rc.root_cause
from hs left join rc using (server_id, window_id)"""


# ------------------------------------------------------------------ registry

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "mask_lines": (q_mask_lines, SQL_MASK_LINES),
    "mask_log_lines": (q_mask_log_lines, SQL_MASK_LOG_LINES),
    "event_times": (q_event_times, SQL_EVENT_TIMES),
    "noise_filtered": (q_noise_filtered, SQL_NOISE_FILTERED),
    "line_display": (q_line_display, SQL_LINE_DISPLAY),
    "lenient_csv": (q_lenient_csv, SQL_LENIENT_CSV),
    "append_dedup": (q_append_dedup, SQL_APPEND_DEDUP),
    "signatures": (q_signatures, SQL_SIGNATURES),
    "doc_signatures": (q_doc_signatures, SQL_DOC_SIGNATURES),
    "templates": (q_templates, SQL_TEMPLATES),
    "doc_templates": (q_doc_templates, None),
    "assigned_templates": (q_assigned_templates, SQL_ASSIGNED_TEMPLATES),
    "sanitized": (q_sanitized, SQL_SANITIZED),
    "distinct_lines": (q_distinct_lines, SQL_DISTINCT_LINES),
    "time_window_counts": (q_time_window_counts, SQL_TIME_WINDOW_COUNTS),
    "line_window_counts": (q_line_window_counts, SQL_LINE_WINDOW_COUNTS),
    "feature_matrix": (q_feature_matrix, SQL_FEATURE_MATRIX),
    "aligned_features": (q_aligned_features, SQL_ALIGNED_FEATURES),
    "latest_window": (q_latest_window, SQL_LATEST_WINDOW),
    "scaler_fit": (q_scaler_fit, SQL_SCALER_FIT),
    "scaled_features": (q_scaled_features, SQL_SCALED_FEATURES),
    "ae_threshold": (q_ae_threshold, SQL_AE_THRESHOLD),
    "ensemble_scores": (q_ensemble_scores, SQL_ENSEMBLE_SCORES),
    "ensemble_without_ae": (q_ensemble_without_ae, SQL_ENSEMBLE_WITHOUT_AE),
    "model_breakdown": (q_model_breakdown, SQL_MODEL_BREAKDOWN),
    "alert_levels": (q_alert_levels, SQL_ALERT_LEVELS),
    "risk_levels": (q_risk_levels, SQL_RISK_LEVELS),
    "alerts": (q_alerts, SQL_ALERTS),
    "alerts_long_suppress": (q_alerts_long_suppress, SQL_ALERTS_LONG),
    "recent_alerts": (q_recent_alerts, SQL_RECENT_ALERTS),
    "alert_stats": (q_alert_stats, SQL_ALERT_STATS),
    "drift": (q_drift, SQL_DRIFT),
    "drift_baseline": (q_drift_baseline, SQL_DRIFT_BASELINE),
    "drift_vs_baseline": (q_drift_vs_baseline, SQL_DRIFT_VS_BASELINE),
    "drift_resets": (q_drift_resets, SQL_DRIFT_RESETS),
    "risk_scores": (q_risk_scores, SQL_RISK_SCORES),
    "trend": (q_trend, SQL_TREND),
    "health": (q_health, SQL_HEALTH),
    "root_cause": (q_root_cause, SQL_ROOT_CAUSE),
    "server_state": (q_server_state, SQL_SERVER_STATE),
    "history_tail": (q_history_tail, SQL_HISTORY_TAIL),
    "kpis": (q_kpis, SQL_KPIS),
    "forecast": (q_forecast, SQL_FORECAST),
    "score_histogram": (q_score_histogram, SQL_SCORE_HISTOGRAM),
    "rolling_rate": (q_rolling_rate, SQL_ROLLING_RATE),
    "top_events": (q_top_events, SQL_TOP_EVENTS),
    "score_report": (q_score_report, SQL_SCORE_REPORT),
}
