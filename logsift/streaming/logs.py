"""Structured Streaming versions of the pipeline (O-S2, O-W3, O-M10, O-A4).

Streams read directories of rolled files (the file source picks up new files; the
checkpoint replaces a byte offset), use event-time watermarks so windows close and state
is dropped, and write with append semantics to tables in the shared folder.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..config import DEFAULT
from ..functions.lines import ts_lit
from ..operators.alerts import DROPPED, SUPPRESSED, Machine, alerting, with_message
from ..session import ship_package


def stream_logs(spark: SparkSession, directory: str, max_files_per_trigger: int | None = None,
                recursive: bool = False) -> DataFrame:
    """O-S2: new lines of new files in ``directory`` → (file, raw_log)."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r.load(directory).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw_log"))


def stream_window_counts(events: DataFrame, seconds: int = 60, watermark: str | None = "10 minutes",
                         key: str = "server_id", event: str = "event_id") -> DataFrame:
    """O-W3: tumbling epoch-aligned windows per (key, event); late rows past the watermark
    are dropped and a window is emitted once the watermark passes its end (append mode)."""
    x = events
    if watermark is not None:  # else ``events`` has its watermark on _ets
        x = events.withColumn("_ets", F.col("ts").cast("timestamp")).withWatermark("_ets", watermark)
    return (x.groupBy(F.col(key), F.window("_ets", f"{seconds} seconds").alias("w"), F.col(event))
             .agg(F.count(F.lit(1)).alias("cnt"))
             .select(key, F.col("w.start").cast("timestamp_ntz").alias("window_start"), event, "cnt"))


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over everything available now into a Parquet table, then stop."""
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", path)
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AlertProcessor(StatefulProcessor):
    """The alert machine of one server on a stream: the last emitted time as a value, running suppressions as a map by key,
    rows that wait for the watermark as a map by (time, window, copy), and a timer at every waiting row's time."""

    def __init__(self, throttle_us: int, suppress_us: int):
        self.throttle, self.suppress = throttle_us, suppress_us

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long")
        self.ends = handle.getMapState("ends", "key string", "end long")
        self.waiting = handle.getMapState("waiting", "t long, window_id long, copy long", "score double, level string, key string, root_cause array<string>")

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        times = set()
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                t, window, copy = int(r.t), int(r.window_id), 0
                if t <= passed:
                    continue  # later than the watermark allows
                while self.waiting.containsKey((t, window, copy)):
                    copy += 1
                self.waiting.updateValue((t, window, copy), (float(r.score), r.level, r.key, [str(x) for x in r.root_cause]))
                times.add(t // 1000 + 1)
        for ms in times:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready = sorted((tuple(k) for k in self.waiting.keys() if k[0] <= passed))
        if not ready:
            return  # an earlier timer has taken them
        before = dict((k[0], v[0]) for k, v in self.ends.iterator())
        machine = Machine(self.throttle, self.suppress, self.last.get()[0] if self.last.exists() else None, before)
        out = []
        for k in ready:
            score, level, name, causes = self.waiting.getValue(k)
            out.append((key[0], k[1], k[0], score, level, list(causes), machine.decide(k[0], name)))
            self.waiting.removeKey(k)
        if machine.last is not None:
            self.last.update((machine.last,))
        for name in before.keys() - machine.ends.keys():
            self.ends.removeKey((name,))
        for name, end in machine.ends.items():
            if before.get(name) != end:
                self.ends.updateValue((name,), (int(end),))
        yield pd.DataFrame(out, columns=["server_id", "window_id", "t", "score", "level", "root_cause", "decision"])


def alerts_stream(scores: DataFrame, throttle: int = DEFAULT.throttle_seconds,
                  suppress: int = DEFAULT.suppress_seconds, watermark: str = "10 minutes") -> DataFrame:
    """O-A4: the alert machine of O-A3 on a stream, state per server in RocksDB.

    Rows may come in any order within the watermark's delay: they wait in the state until the
    watermark has passed them and are then taken in time order, so the result is that of the batch
    operator; later ones are dropped. A query that starts again from its checkpoint goes on where it stopped.
    """
    spark = scores.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    x = alerting(scores).withColumn("_ets", F.col("ts").cast("timestamp")).withWatermark("_ets", watermark)
    x = x.select("server_id", F.col("window_id").cast("long").alias("window_id"), F.col("_t").alias("t"), "score", "level", F.col("_key").alias("key"), "root_cause", "_ets")
    decided = x.groupBy("server_id").transformWithStateInPandas(
        AlertProcessor(throttle * 1_000_000, suppress * 1_000_000),
        "server_id string, window_id long, t long, score double, level string, root_cause array<string>, decision string", "Append", "EventTime")
    decided = decided.filter(F.col("decision") != DROPPED)
    ts = F.timestamp_add("MICROSECOND", F.col("t"), ts_lit("1970-01-01 00:00:00"))
    return with_message(decided.withColumn("ts", ts).withColumn("suppressed", F.col("decision") == SUPPRESSED)).drop("t")


#: What makes a streamed line the same as an earlier one.
LINE_KEY = ("server_id", "raw_log", "event_id")


def _run(query) -> list:
    """Runs a stream to the end of what is there; its progress, batch by batch."""
    q = query.trigger(availableNow=True).start()
    q.awaitTermination()
    return q.recentProgress


def structure_stream(lines: DataFrame, templates: DataFrame, path: str, checkpoint: str, ingest_ts) -> int:
    """Structured lines of a stream, appended to a table bucketed by their hash, each (server, line, event) once however far apart its
    repeats come: every micro-batch is joined against the keys that the table has from earlier batches, without a
    shuffle of them. A batch's rows are dealt to the table's buckets first, so it adds one file a bucket, however many tasks it has: the
    stream that reads the table takes so many files a micro-batch. A batch that runs again overwrites its own partition. Returns the
    number of micro-batches."""
    from ..functions import lines as L
    from ..operators import templates as TM
    from ..sources.text import TABLE_BUCKETS, bucketed_table, missing_rows, row_key

    x = lines.filter(L.is_nonblank("raw_log"))
    x = L.evaluate_once(x, raw_log=L.clean_line("raw_log", ingest_ts)).filter(~L.is_noise("raw_log"))
    if "server_id" not in x.columns:
        x = x.withColumn("server_id", F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1))
    x = TM.assign_templates(x, templates).withColumn("ts", L.event_time("raw_log", ingest_ts)).select(*LINE_KEY, "ts")

    def per_batch(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        part = f"{batch_id:012d}"
        with bucketed_table(spark, path, (*LINE_KEY, ("ts", "timestamp_ntz")), "batch") as name:
            once = batch.groupBy(*LINE_KEY).agg(F.min("ts").alias("ts")).withColumn("row_key", row_key(LINE_KEY)).repartition(TABLE_BUCKETS, "row_key")
            new = missing_rows(once, spark.table(name).filter(F.col("batch") < part), LINE_KEY)
            new.select(*LINE_KEY, "ts", "row_key", F.lit(part).alias("batch")).write.insertInto(name, overwrite=True)

    return len(_run(x.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)))


def score_stream(lines: DataFrame, model, templates: DataFrame, out_path: str, checkpoint: str,
                 ingest_ts, seconds: int = 60, watermark: str = "10 minutes", max_files_per_trigger: int | None = None) -> dict:
    """O-M10: score every window of a line stream once it closes; append to ``out_path``.

    Two streams over what is there, each with its checkpoint, so a stopped job goes on where it was: lines are structured and repeats
    dropped (``structure_stream``); the table that this makes is streamed into epoch-aligned windows with a watermark, and every
    micro-batch of closed windows is scored with the batch scorer inside ``foreachBatch``. Rows later than the watermark
    are in no window. Returns how many micro-batches there were and how many rows were late.
    """
    from ..plans.stages import score_windows

    spark = lines.sparkSession
    table = f"{out_path}-lines"
    batches = structure_stream(lines, templates, table, f"{checkpoint}/lines", ingest_ts)
    r = spark.readStream.schema("server_id string, event_id string, ts timestamp_ntz")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    counts = stream_window_counts(r.option("recursiveFileLookup", "true").parquet(table), seconds, watermark)

    def per_batch(batch: DataFrame, batch_id: int):
        batch = batch.persist()  # read twice below (scores and window starts)
        c = batch.withColumn("window_id", F.floor(
            F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("window_start"))
            / seconds).cast("bigint"))
        scored = score_windows(c.select("server_id", "window_id", "event_id", "cnt"), model)
        starts = c.select("server_id", "window_id", "window_start").distinct()
        # one folder per micro-batch, overwritten on a retry: exactly-once output
        scored.join(starts, ["server_id", "window_id"]).write.mode("overwrite").parquet(
            f"{out_path}/batch_id={batch_id}")
        batch.unpersist()

    progress = _run(counts.writeStream.outputMode("append").foreachBatch(per_batch).option("checkpointLocation", f"{checkpoint}/windows"))
    late = sum(int(o.numRowsDroppedByWatermark) for p in progress for o in p.stateOperators)
    return {"line_batches": batches, "window_batches": len(progress), "late_rows": late}
