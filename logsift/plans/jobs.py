"""Registered queries for models, file sources, sinks and streams.

Most are checked rows-only plus invariants in ``tests/``; the streamed window counts and the
line windows of files read back with ``read_logs`` also have DuckDB twins.

Intermediate tables (written text logs, score tables, stream sinks and checkpoints) go
to a fresh folder under the session's ``spark.checkpoint.dir`` for every call.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..operators import alerts as A
from ..operators import autoencoder as AE
from ..operators import forest as FO
from ..operators import monitoring as M
from ..operators.ensemble import ae_threshold
from ..operators import features as FE
from ..session import materialize, path_kind, scratch_path, table
from ..sources import text as TX
from ..streaming import logs as ST
from . import stages as P
from . import sql as Q
from .registry import INGEST, SQL_ALERTS_LONG, SQL_LENIENT_CSV, lines, minute_counts, r6, scores, ts_text

KEYS = ["server_id", "window_id"]


def _scratch(spark, what: str) -> str:
    return scratch_path(spark, f"{what}-{uuid.uuid4().hex[:12]}")


def _event_vectors(spark, sf):
    """Scaled sparse vectors of the per-minute windows, written once, and their base."""
    c = materialize(minute_counts(spark, sf), "counts")
    columns, base = P.model_columns(c)
    return P.training_vectors(c, columns)[0], base


def q_forest_scores(spark, sf):
    """O-M2/M3 on the per-minute event windows: trained and scored on all windows."""
    vec, base = _event_vectors(spark, sf)
    nodes, meta = FO.fit_forest(vec, KEYS, base=base)
    raw = FO.score_forest(vec, nodes, meta["psi"], base=base)
    off = FO.forest_offset(raw)
    out = FO.score_forest(vec, nodes, meta["psi"], off, base)
    return out.select(*KEYS, r6("if_raw").alias("if_raw"), r6("if_score").alias("if_score"), "if_prediction")


def q_forest_scores_embeddings(spark, sf):
    """O-M2/M3 on a second matrix: the embedding vectors."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    nodes, meta = FO.fit_forest(e, ["vec_id"])
    raw = FO.score_forest(e, nodes, meta["psi"])
    off = FO.forest_offset(raw)
    out = FO.score_forest(e, nodes, meta["psi"], off)
    return out.select("vec_id", r6("if_score").alias("if_score"), "if_prediction")


def closed_form_forest(spark, n_trees=10, levels=5, dim=64):
    """A node table by formulas: complete binary trees, numbered from the root, that end early in places."""
    width = (1 << levels + 1) - 1
    n = spark.range(n_trees * width).select((F.col("id") / width).cast("int").alias("tree_id"), (F.col("id") % width).cast("int").alias("node_id"))
    n = n.withColumn("depth", F.floor(F.log2(F.col("node_id") + F.lit(1.5))).cast("int"))
    leaf = (F.col("depth") == levels) | ((F.col("node_id") * 7 + F.col("tree_id")) % 11 == 0)
    return n.select(
        "tree_id", "node_id", F.when(leaf, -1).otherwise((F.col("tree_id") * 7 + F.col("node_id") * 3) % dim).cast("int").alias("feature"),
        (((F.col("node_id") * 37 + F.col("tree_id") * 11) % 100 - 50) / 100.0).alias("threshold"),
        F.when(leaf, -1).otherwise(F.col("node_id") * 2 + 1).cast("int").alias("left"), F.when(leaf, -1).otherwise(F.col("node_id") * 2 + 2).cast("int").alias("right"),
        (F.lit(1) + (F.col("node_id") * 13 + F.col("tree_id")) % 40).cast("long").alias("size"), "depth")


def q_forest_walk(spark, sf):
    """O-M3 as relations: all embedding vectors scored against a forest in closed form, by joins with its node table."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    out = FO.walk_forest(e, closed_form_forest(spark), ["vec_id"], psi=256, levels=5)
    return out.select("vec_id", r6("if_raw").alias("if_raw"))


SQL_FOREST_WALK = """with recursive nodes as (
  select t as tree_id, i as node_id, d as depth, (d = 5 or (i * 7 + t) % 11 = 0) as leaf, (t * 7 + i * 3) % 64 as feature,
    ((i * 37 + t * 11) % 100 - 50) / 100.0::double as threshold, cast(1 + (i * 13 + t) % 40 as double) as size
  from (select unnest(range(10)) as t) a, (select i, cast(floor(log2(i + 1.5)) as integer) as d from (select unnest(range(63)) as i)) b),
walk as (
  select vec_id, embedding, tree_id, 0::bigint as node_id, 0 as step from embeddings, (select unnest(range(10)) as tree_id)
  union all
  select w.vec_id, w.embedding, w.tree_id,
    case when cast(w.embedding[n.feature + 1] as double) < n.threshold then 2 * w.node_id + 1 else 2 * w.node_id + 2 end, w.step + 1
  from walk w join nodes n on n.tree_id = w.tree_id and n.node_id = w.node_id where not n.leaf),
paths as (
  select vec_id, sum(n.depth + case when size > 2 then 2.0 * (ln(size - 1.0) + 0.5772156649015329) - 2.0 * (size - 1.0) / size when size = 2 then 1.0 else 0.0 end) as p
  from walk w join nodes n on n.tree_id = w.tree_id and n.node_id = w.node_id where n.leaf group by 1)
select vec_id, 0.0 + round(-pow(2.0, -(p / 10) / (2.0 * (ln(255.0) + 0.5772156649015329) - 2.0 * 255.0 / 256.0)), 6) as if_raw from paths"""


def q_ae_scores(spark, sf):
    """O-M4/M5: autoencoder trained on the event windows; error, threshold, score, prediction."""
    vec, base = _event_vectors(spark, sf)
    model = AE.fit_autoencoder(vec, KEYS, base=base)
    mse = AE.mse_table(vec, model, base)
    thr = ae_threshold(mse.select("mse"))
    t = F.lit(float(thr))
    return mse.select(*KEYS, r6("mse").alias("mse"),
                      r6(F.when(t > 0, F.lit(0.0) - F.col("mse") / t).otherwise(F.lit(0.0) - F.col("mse"))).alias("ae_score"),
                      F.when(F.col("mse") > t, -1).otherwise(1).alias("ae_prediction"),
                      F.lit(round(thr, 6)).alias("threshold"))


def _structured(spark, sf, params: Params = DEFAULT):
    """Structured rows written once as a table (read for the time origin, then for counts)."""
    s, templates = P.structure_lines(lines(spark, sf), INGEST, params)
    return materialize(s, "structured"), templates


def q_train_job(spark, sf):
    """O-M9 + E4: log lines → structure → 60 s windows → train both models → score windows."""
    s, _ = _structured(spark, sf)
    counts = P.window_counts(s).persist()
    model = P.train_models(counts)
    out = P.score_windows(counts, model)
    return out.select(*KEYS, r6("if_score").alias("if_score"), r6("ae_score").alias("ae_score"),
                      r6("score").alias("score"), "prediction")


def q_model_roundtrip(spark, sf):
    """O-S9: save the trained model, load it back and score again (forest only and full)."""
    s, _ = _structured(spark, sf)
    counts = P.window_counts(s).persist()
    model = P.train_models(counts)
    path = _scratch(spark, "model")
    P.save_model(spark, model, path)
    back = P.load_model(spark, path)
    a = P.score_windows(counts, model).select(*KEYS, F.col("score").alias("score_trained"))
    b = P.score_windows(counts, back).select(*KEYS, F.col("score").alias("score_loaded"))
    return a.join(b, KEYS).select(*KEYS, r6("score_trained").alias("score_trained"),
                                  r6("score_loaded").alias("score_loaded"))


def q_ingest_job(spark, sf):
    """E1 + O-S5/S6/S7: structure the lines, write a provenance copy and metadata, append
    twice to the structured table (the second append adds nothing) and list ingests."""
    root = _scratch(spark, "ingest")
    s, _ = _structured(spark, sf)
    TX.write_provenance(s.drop("window_id") if "window_id" in s.columns else s, root, "external", "driver", INGEST)
    structured = s.select("raw_log", "event_id", "event_template", ts_text("ts").alias("ts"))
    first = TX.append_structured(structured, f"{root}/structured", "2024-02-01")
    again = TX.append_structured(structured, f"{root}/structured", "2024-02-01")
    listing = TX.list_provenance(spark, root, 20)
    return listing.select("ingest_id", "source", "uploader", "rows",
                          F.lit(first).alias("appended_first"), F.lit(again).alias("appended_again"))


SQL_INGEST_JOB = Q.with_(Q.LOG_LINES, Q.PROCESSED, Q.SIGNED, Q.MINED, Q.STRUCTURED) + """
select 'external_structured_20240201T000000Z' as ingest_id, 'external' as source, 'driver' as uploader, count(*) as "rows",
  cast(count(distinct (raw_log, event_id, event_template, ets)) as integer) as appended_first, cast(0 as integer) as appended_again
from structured"""


def q_provenance_preview(spark, sf):
    """O-S8: the first 50 structured rows of an ingest (partition-pruned read)."""
    root = _scratch(spark, "ingest")
    s, _ = _structured(spark, sf)
    meta = TX.write_provenance(s, root, "external", None, INGEST)
    return TX.preview(spark, root, meta["ingest_id"], 50).select("line_no", "raw_log", "event_id")


SQL_PROVENANCE_PREVIEW = Q.with_(Q.LOG_LINES, Q.PROCESSED, Q.SIGNED, Q.MINED, Q.STRUCTURED) + """
select line_no, raw_log, event_id from structured order by line_no limit 50"""


def q_provenance(spark, sf):
    """O-S6/S7: two ingests of the log lines (by server half) and the provenance listing."""
    root = _scratch(spark, "ingest")
    s, _ = _structured(spark, sf)
    for i, part in enumerate(("[0-3]", "[4-7]")):
        sub = s.filter(F.col("server_id").rlike(f"server-{part}$"))
        TX.write_provenance(sub, root, f"half{i}", "driver", INGEST + dt.timedelta(hours=i))
    return TX.list_provenance(spark, root, 20).select("ingest_id", "source", "uploader", "rows")


SQL_PROVENANCE = Q.with_(Q.LOG_LINES, Q.PROCESSED, Q.SIGNED, Q.MINED, Q.STRUCTURED) + """
select 'half' || half || '_structured_20240201T0' || half || '0000Z' as ingest_id, 'half' || half as source, 'driver' as uploader,
  count(*) as "rows" from (select *, case when server_id <= 'server-3' then '0' else '1' end as half from structured) group by half"""


def q_live_snapshot(spark, sf):
    """O-A25: latest score, diagnosis, last 20 lines (newest first) and indexed history per server, lists as text."""
    snap = M.live_snapshot(scores(spark, sf), lines(spark, sf), 20, 1000)
    history = F.transform("history", lambda h: F.concat_ws(":", h["idx"].cast("string"), F.format_string("%.6f", h["score"])))
    return snap.select("server_id", "score", "diagnosis", F.array_join("recent_logs", "\n").alias("recent_logs"),
                       F.array_join(history, " ").alias("history"))


SQL_LIVE_SNAPSHOT = Q.with_(Q.SCORES, Q.LOG_LINES, """recent as (
  select server_id, string_agg(raw_log, chr(10) order by r) as recent_logs from (
    select *, row_number() over (partition by server_id order by ts desc, line_no desc) as r from log_lines) where r <= 20 group by 1),
hist as (
  select server_id, string_agg(cast(idx as varchar) || ':' || printf('%.6f', score), ' ' order by idx) as history from (
    select *, row_number() over (partition by server_id order by ts, window_id) - 1 as idx,
      row_number() over (partition by server_id order by ts desc, window_id desc) as r from scores) where r <= 1000 group by 1)""") + """
select server_id, arg_max(score, ts) as score,
  case when arg_max(prediction, ts) = -1 then 'CRITICAL' else 'Healthy' end as diagnosis,
  any_value(recent_logs) as recent_logs, any_value(history) as history
from scores left join recent using (server_id) left join hist using (server_id) group by 1"""


def _events_stream(spark, sf):
    ev = table(spark, sf, "events")
    path = f"{sf}/events.parquet"
    stream = spark.readStream.schema(ev.schema)
    if path_kind(spark, path) == "dir":  # a table of part files
        src = stream.parquet(path)
    else:  # one file: a file source reads its folder
        src = stream.option("pathGlobFilter", "events.parquet").parquet(sf)
    # a far-future row moves the watermark past every real window so all of them close
    closing = _scratch(spark, "closing")
    spark.sql("select -1L as event_id, timestamp_ntz'2100-01-01 00:00:00' as ts, -1L as user_id, "
              "'closing' as event_type, 0.0D as value, '' as props").write.parquet(closing)
    return src.unionByName(spark.readStream.schema(ev.schema).parquet(closing))


def q_stream_window_counts(spark, sf):
    """O-W3: 60 s epoch-aligned counts per (server, event) from ``events`` read as a stream."""
    ev = _events_stream(spark, sf).select(
        F.concat(F.lit("server-"), (F.col("user_id") % 8).cast("string")).alias("server_id"),
        "ts", F.col("event_type").alias("event_id"))
    counts = ST.stream_window_counts(ev, 60, "10 minutes")
    out, ck = _scratch(spark, "w3"), _scratch(spark, "w3-ckpt")
    ST.run_to_table(counts, out, ck)
    res = spark.read.parquet(out).filter(F.col("event_id") != "closing")
    return res.select("server_id", ts_text("window_start").alias("window_start"), "event_id", "cnt")


SQL_STREAM_WINDOW_COUNTS = """
select 'server-' || cast(user_id % 8 as varchar) as server_id,
  strftime(time_bucket(interval '60 seconds', ts), '%Y-%m-%d %H:%M:%S.%f') as window_start,
  event_type as event_id, count(*) as cnt
from events group by 1, 2, 3"""


def q_alerts_stream(spark, sf, throttle=43200, suppress=172800):
    """O-A4: the score series written in files and read as a stream, a file per micro-batch, through the
    stateful alert machine. Files hold any rows of a ten-day cut, so the watermark waits that long."""
    src = _scratch(spark, "scores")
    s = scores(spark, sf)
    cut = F.floor(F.day("ts") / 10).cast("int")
    s = materialize(s.withColumn("_cut", cut), "score-series")
    for k in range(4):
        s.filter(F.col("_cut") == k).drop("_cut").write.mode("append").parquet(src)
    # a row far in the future, written last, moves the watermark past all real ones
    spark.createDataFrame([("closing", -1, dt.datetime(2100, 1, 1), -1.0)], "server_id string, window_id long, ts timestamp_ntz, score double") \
        .write.mode("append").parquet(src)
    stream = spark.readStream.schema("server_id string, window_id long, ts timestamp_ntz, score double").option("maxFilesPerTrigger", 1).parquet(src)
    alerts = ST.alerts_stream(stream, throttle, suppress, "11 days")
    out, ck = _scratch(spark, "a4"), _scratch(spark, "a4-ckpt")
    ST.run_to_table(alerts.drop("root_cause"), out, ck)
    return spark.read.parquet(out).filter(F.col("server_id") != "closing").select(
        "server_id", "window_id", ts_text("ts").alias("ts"), "score", "level", "decision", "suppressed", "message")


def _rolled_logs(spark, sf) -> str:
    """Log lines as rolled text files per server and day."""
    src = _scratch(spark, "logs")
    lines(spark, sf).select("server_id", F.to_date("ts").alias("day"), "raw_log") \
        .repartition("server_id", "day").write.partitionBy("server_id", "day").text(src)
    return src


def _closing_line(spark, src: str) -> None:
    """A line far in the future closes every real window."""
    spark.createDataFrame([("2100-01-01T00:00:00 closing line",)], "raw_log string") \
        .write.text(f"{src}/server_id=server-closing/day=2100-01-01")


def log_file_stream(spark, src: str, max_files_per_trigger: int | None = None):
    return ST.stream_logs(spark, src, max_files_per_trigger, recursive=True).select(
        F.regexp_extract("file", r"server_id=([^/]+)", 1).alias("server_id"), "raw_log")


def q_score_stream(spark, sf):
    """O-M10: log lines written as rolled text files per server and day, streamed in several micro-batches in
    whatever order the files are found, windowed and scored with a model trained in batch on the same lines."""
    s, templates = _structured(spark, sf)
    templates = templates.persist()
    counts = materialize(P.window_counts(s), "counts")  # read by every step of the training
    model = P.train_models(counts)
    src = _rolled_logs(spark, sf)
    _closing_line(spark, src)
    out, ck = _scratch(spark, "m10"), _scratch(spark, "m10-ckpt")
    # files come in any order, so the watermark waits for all days
    ST.score_stream(log_file_stream(spark, src, 100), model, templates, out, ck, INGEST, watermark="60 days", max_files_per_trigger=100)
    res = spark.read.parquet(out).filter("server_id != 'server-closing'")
    return res.select("server_id", ts_text("window_start").alias("window_start"), r6("score").alias("score"),
                      "prediction")


def q_alerts_with_causes(spark, sf):
    """O-A3 with root causes in the suppression key and message (score report input)."""
    from .registry import _template_counts
    counts, t = _template_counts(spark, sf)
    causes = M.cause_lists(M.root_cause(counts, t, top_n=5), n=3)
    sc = scores(spark, sf).join(causes, KEYS, "left").withColumn(
        "root_cause", F.coalesce(F.col("root_cause"), F.array().cast("array<string>")))
    a = A.generate_alerts(sc, 43200, 172800)
    return a.select("server_id", "window_id", "level", "decision", "message")


def _write_log_files(spark, sf) -> str:
    """Rendered log lines written as rolled text files, one folder per server and day."""
    src = _scratch(spark, "logfiles")
    (lines(spark, sf).select("server_id", F.to_date("ts").alias("day"), "line_no", "raw_log")
        .repartition("server_id", "day").sortWithinPartitions("server_id", "day", "line_no")
        .select("server_id", "day", "raw_log")
        .write.partitionBy("server_id", "day").text(src))
    return src


def q_read_logs(spark, sf):
    """O-S1 + O-W2: text files read back with exact per-file line numbers, line windows of
    100 per file, and template-free counts per window (lines, error lines)."""
    from ..functions.lines import is_error_line
    src = _write_log_files(spark, sf)
    x = TX.read_logs(spark, src)
    x = (x.withColumn("server_id", F.regexp_extract("file", r"server_id=([^/]+)", 1))
          .withColumn("day", F.regexp_extract("file", r"day=([^/]+)", 1)))
    from ..operators.windows import line_windows
    w = line_windows(x, 100)
    return w.groupBy("server_id", "day", "window_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(is_error_line("raw_log")).alias("error_lines"),
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


SQL_READ_LOGS = """with """ + Q.LOG_LINES + """,
n as (select server_id, cast(cast(ts as date) as varchar) as day, raw_log,
        row_number() over (partition by server_id, cast(ts as date) order by line_no) - 1 as ln from log_lines)
select server_id, day, ln // 100 as window_id, count(*) as lines,
  count(*) filter (where contains(raw_log, 'ERROR') or contains(raw_log, 'FATAL')) as error_lines,
  min(ln) as first_line, max(ln) as last_line
from n group by all"""


def q_structured_csv(spark, sf):
    """O-S3: structured rows written as a quoted CSV with header and read back typed."""
    s, _ = _structured(spark, sf)
    path = _scratch(spark, "structured-csv")
    (s.select("raw_log", "event_id", "event_template", ts_text("ts").alias("ts"))
      .write.option("header", True).option("escape", '"').csv(path))
    back = TX.read_structured_csv(spark, path)
    return back.select("raw_log", "event_id", "event_template", "ts")


SQL_STRUCTURED_CSV = Q.with_(Q.LOG_LINES, Q.PROCESSED, Q.SIGNED, Q.MINED, Q.STRUCTURED) + f"""
select raw_log, event_id, event_template, {Q.ts_text('ets')} as ts from structured"""


def q_lenient_files(spark, sf):
    """O-S4 on files: comma-joined structured rows (commas inside the text) with a header,
    parsed by splitting from the right."""
    from .registry import _csv_text
    path = _scratch(spark, "lenient")
    body = _csv_text(spark, sf).select("value")
    header = spark.createDataFrame([(TX.HEADER,)], "value string")
    header.unionByName(body).write.text(path)
    back = TX.read_structured_lenient(spark, path)
    return back.select("raw_log", "event_id", "event_template", ts_text("ts").alias("ts"))


SQL_LENIENT_FILES = f"""
select raw_log, event_id, event_template, {Q.ts_text("try_strptime(ts_text, '%Y-%m-%dT%H:%M:%S')")} as ts from ({SQL_LENIENT_CSV})"""


JOBS = {
    "read_logs": (q_read_logs, SQL_READ_LOGS),
    "structured_csv": (q_structured_csv, SQL_STRUCTURED_CSV),
    "lenient_files": (q_lenient_files, SQL_LENIENT_FILES),
    "forest_scores": (q_forest_scores, None),
    "forest_scores_embeddings": (q_forest_scores_embeddings, None),
    "forest_walk": (q_forest_walk, SQL_FOREST_WALK),
    "ae_scores": (q_ae_scores, None),
    "train_job": (q_train_job, None),
    "model_roundtrip": (q_model_roundtrip, None),
    "ingest_job": (q_ingest_job, SQL_INGEST_JOB),
    "provenance": (q_provenance, SQL_PROVENANCE),
    "provenance_preview": (q_provenance_preview, SQL_PROVENANCE_PREVIEW),
    "live_snapshot": (q_live_snapshot, SQL_LIVE_SNAPSHOT),
    "stream_window_counts": (q_stream_window_counts, SQL_STREAM_WINDOW_COUNTS),
    "alerts_stream": (q_alerts_stream, SQL_ALERTS_LONG),
    "score_stream": (q_score_stream, None),
    "alerts_with_causes": (q_alerts_with_causes, None),
}

