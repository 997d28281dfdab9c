"""Streams equal their batch twins."""

import datetime as dt
import random

from pyspark.sql import functions as F

from logsift.config import Params
from logsift.operators import alerts as A
from logsift.operators import features as FE
from logsift.operators import windows as W
from logsift.plans import jobs as J
from logsift.plans import stages as P
from logsift.plans.registry import INGEST, lines, scores, ts_text
from logsift.sources import text as TX
from logsift.streaming import logs as ST

from conftest import SF_SMALL, SF_MID


def rows(df):
    return sorted(tuple(r) for r in df.collect())


rows_of = rows


def test_alerts_stream_equals_batch(spark):
    s = J.q_alerts_stream(spark, SF_MID)
    b = A.generate_alerts(scores(spark, SF_MID), 43200, 172800).select(
        "server_id", "window_id", ts_text("ts").alias("ts"), "score", "level", "decision", "suppressed", "message")
    assert rows(s) == rows(b)


def test_stream_window_counts_equal_batch(spark):
    s = J.q_stream_window_counts(spark, SF_SMALL)
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    b = ev.groupBy(F.concat(F.lit("server-"), (F.col("user_id") % 8).cast("string")).alias("server_id"),
                   ts_text(F.window("ts", "60 seconds").start).alias("window_start"),
                   F.col("event_type").alias("event_id")).agg(F.count(F.lit(1)).alias("cnt"))
    assert rows(s) == rows(b)


def trained(spark):
    """Templates and a model of the small table's log lines."""
    s, templates = J._structured(spark, SF_SMALL)
    return templates.persist(), P.train_models(P.window_counts(s), Params(epochs=2, n_trees=10))


def batch_scores(spark, templates, model, keep=None):
    """What the stream must give: each (server, line, event) once, windows from the epoch."""
    x, _ = P.structure_lines(lines(spark, SF_SMALL), INGEST, dedupe=False, templates=templates)
    x = x.dropDuplicates(list(ST.LINE_KEY))
    x = x if keep is None else x.filter(keep)
    return P.score_windows(FE.feature_counts(W.epoch_windows(x, 60)), model)


def keyed(df, window="window_id"):
    return {(r["server_id"], r[window]): round(r["score"], 9) for r in df.collect()}


def test_score_stream_over_many_batches_restarts_and_repeats_equals_batch(spark, tmp_path):
    """Half of the files, a stop, the other half with all lines of the first one again, and the closing line."""
    templates, model = trained(spark)
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    x = lines(spark, SF_SMALL).select("server_id", F.to_date("ts").alias("day"), "raw_log")
    first = x.filter(F.crc32(F.col("raw_log").cast("binary")) % 2 == 0)
    again = x.filter("day = '2024-01-03'")
    told = []
    for part in (first, x.unionByName(again), None):
        if part is None:
            J._closing_line(spark, src)
        else:
            part.repartition(4, F.rand(1)).write.mode("append").partitionBy("server_id", "day").text(src)
        told.append(ST.score_stream(J.log_file_stream(spark, src, 300), model, templates, out, ck, INGEST, watermark="60 days", max_files_per_trigger=100))
    got = spark.read.parquet(out).filter("server_id != 'server-closing'")
    assert got.groupBy("server_id", "window_id").count().filter("count > 1").count() == 0
    assert keyed(got) == keyed(batch_scores(spark, templates, model))
    assert sum(t["line_batches"] for t in told) >= 5 and [t["late_rows"] for t in told] == [0, 0, 0]


def test_a_batch_of_lines_adds_one_file_a_bucket(spark, tmp_path):
    """However many tasks a micro-batch has: the windows' stream takes so many files of the table at a time."""
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "lines"), str(tmp_path / "ck")
    rows = [(f"s{i % 3}", f"2024-01-01T00:{i % 60:02d}:00 INFO served {i // 60} of a") for i in range(3000)]
    x = spark.createDataFrame(rows + rows[:50], "server_id string, raw_log string")
    x.repartition(4).write.partitionBy("server_id").text(src)
    templates = spark.createDataFrame([], "signature string, event_template string, event_id string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        batches = ST.structure_stream(J.log_file_stream(spark, src), templates, out, ck, INGEST)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert batches == 1 and len(list((tmp_path / "lines").rglob("*.parquet"))) <= TX.TABLE_BUCKETS
    got = spark.read.parquet(out)
    assert sorted((r.server_id, r.raw_log) for r in got.select("server_id", "raw_log").collect()) == sorted(rows)


def test_late_rows_are_counted_and_in_no_window(spark, tmp_path):
    """January's last days come first; with a watermark of one day the first days are late."""
    templates, model = trained(spark)
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    x = lines(spark, SF_SMALL).select("server_id", "ts", F.to_date("ts").alias("day"), "raw_log").filter(F.col("raw_log").startswith("2024"))
    late = 0
    for part in ("day >= '2024-01-20'", "day < '2024-01-10'", None):
        if part is None:
            J._closing_line(spark, src)
        else:
            x.filter(part).drop("ts").coalesce(1).write.mode("append").partitionBy("server_id", "day").text(src)
        late += ST.score_stream(J.log_file_stream(spark, src), model, templates, out, ck, INGEST, watermark="1 day")["late_rows"]
    got = spark.read.parquet(out).filter("server_id != 'server-closing'")
    kept = (F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("ts") < F.lit(INGEST).cast("timestamp_ntz"))  # lines without a time were left out
    assert keyed(got) == keyed(batch_scores(spark, templates, model, kept))
    early, _ = P.structure_lines(lines(spark, SF_SMALL), INGEST, dedupe=False, templates=templates)
    early = early.dropDuplicates(list(ST.LINE_KEY)).filter(F.col("raw_log").startswith("2024") & (F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")))
    groups = early.groupBy("server_id", F.window("ts", "60 seconds"), "event_id").count().count()
    assert groups <= late <= early.count()  # Spark counts them after the partial aggregate of a task


def test_alerts_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Stopped after each of four parts and started again, with rows of a part in any order, late rows and equal rows."""
    schema = "server_id string, window_id long, ts timestamp_ntz, score double"
    rng = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(s, k, t0 + dt.timedelta(minutes=7 * k), rng.choice([-0.95, -0.75, -0.55, -0.1])) for s in ("a", "b") for k in range(200)]
    rows += rows[10:12]
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    part = lambda k: [r for r in rows if (r[2] - t0) // dt.timedelta(minutes=350) == k]
    late = [("a", 999, t0 + dt.timedelta(minutes=1), -0.95)]
    for k in range(5):
        mine = part(k) + (late if k == 3 else []) if k < 4 else [("closing", 0, dt.datetime(2100, 1, 1), -0.95)]
        rng.shuffle(mine)
        spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        ST.run_to_table(ST.alerts_stream(stream, 1800, 7200, "6 hours").drop("root_cause"), out, ck)
    cols = ["server_id", "window_id", "ts", "score", "level", "decision", "suppressed", "message"]
    got = spark.read.parquet(out).filter("server_id != 'closing'").select(cols)
    want = A.generate_alerts(spark.createDataFrame(rows, schema), 1800, 7200).select(cols)
    assert rows_of(got) == rows_of(want) and got.count() > 20
