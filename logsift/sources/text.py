"""Text and structured-table sources and sinks (O-S1, S3 … S8)."""

from __future__ import annotations

import datetime as dt
import os
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lines import is_nonblank, strip_ws
from ..session import materialize, path_kind, ship_package

STRUCTURED_COLUMNS = ("raw_log", "event_id", "event_template", "ts")
HEADER = "Raw_Log,Event_ID,Event_Template,Timestamp"

STRUCTURED_SCHEMA = T.StructType([
    T.StructField("raw_log", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("event_template", T.StringType()),
    T.StructField("ts", T.StringType()),
])


#: Splits of which a task may hold a number each (16 bytes; at 128 MB a split this is a petabyte). Beyond it, what is
#: known of splits is joined by a shuffle.
MOST_SPLITS = 8 << 20


def _split_lines(spark: SparkSession, paths, **options) -> DataFrame:
    """(value, file, file_mtime, split, _pos): the lines of text files; ``split`` names a byte range of a file, and ``_pos`` rises inside it."""
    return (spark.read.options(**options).text(paths)
                 .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
                         F.col("_metadata.file_modification_time").alias("file_mtime"))
                 .withColumn("split", F.xxhash64("file", "_block")).withColumn("_pos", F.monotonically_increasing_id()))


def _before(splits: DataFrame, value: str, out: str) -> DataFrame:
    """``splits`` (file, _block, ``value``, …) with the sum of ``value`` over the splits of the file before each."""
    ahead = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn(out, F.coalesce(F.sum(value).over(ahead), F.lit(0)))


def _with_splits(lines: DataFrame, splits: DataFrame, most: int = MOST_SPLITS) -> DataFrame:
    """``lines`` with the numbers of ``splits`` (split, …), sent to the tasks that read them where they are few enough: the text stays
    where it is read."""
    return lines.join(F.broadcast(splits) if splits.count() <= most else splits, "split")


def read_logs(spark: SparkSession, paths, source: str | None = None) -> DataFrame:
    """O-S1: lines of one or more text files → (source, file, file_mtime, line_no, raw_log).

    ``line_no`` is the exact 0-based line number inside its file (blank lines count), so
    line windows (O-W2) are reproducible. Lines are counted per file split first; what comes before each split is a
    prefix sum over that small table, and every task adds its split's number to the lines that it reads, so
    no text is shuffled. Blank lines are then dropped,
    the text stripped, and undecodable bytes (U+FFFD) removed.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = _split_lines(spark, paths)
    splits = df.groupBy("file", "_block", "split").agg(F.min("_pos").alias("_p0"), F.count(F.lit(1)).alias("_n"))
    splits = materialize(_before(splits, "_n", "_off").select("split", (F.col("_off") - F.col("_p0")).alias("_shift")), "line-splits")
    x = _with_splits(df, splits).withColumn("line_no", F.col("_pos") + F.col("_shift"))
    x = x.withColumn("raw_log", strip_ws(F.regexp_replace("value", "\ufffd", "")))
    x = x.filter(F.length("raw_log") > 0)
    src = F.lit(source) if source else F.col("file")
    return x.select(src.alias("source"), "file", "file_mtime", "line_no", "raw_log")


def _join_records(batches):
    """Lines of splits in order, each with whether a quoted field is open at its split's start, to records: a record ends with the line
    after which the quotes are even. The pieces of a record that crosses a split's edge come out as they are: ``place`` is the line's
    place in the file for whole records, and pieces are marked open."""
    split, held, first, at, quoted = None, [], None, None, False

    def row(text: bytes, place: tuple, head: bool, tail: bool) -> tuple:
        return (*place, text, head, tail)

    for b in batches:
        out = []
        for file, block, pos, value, opened in zip(*(b.column(c).to_pylist() for c in ("file", "_block", "_pos", "line", "opened")), strict=True):
            if (file, block) != split:
                if held:  # the split before ends inside a record
                    out.append(row(b"\n".join(held), (*split, at), first, True))
                split, held, quoted, first = (file, block), [], opened, opened
            if not held:
                at = pos
            held.append(value)
            quoted ^= bool(value.count(b'"') & 1)
            if not quoted:
                out.append(row(b"\n".join(held), (*split, at), first, False))
                held, first = [], False
        yield _record_batch(out)
    if held:
        yield _record_batch([row(b"\n".join(held), (*split, at), first, True)])


_RECORD = "file string, _block long, _pos long, record string, _head boolean, _tail boolean"


def _record_batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_())
    arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
    arrays[3] = arrays[3].cast(pa.string())
    return pa.RecordBatch.from_arrays(arrays, names=["file", "_block", "_pos", "record", "_head", "_tail"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, is_first): the records of quoted CSV files, whose fields may hold line breaks; a file is read by as many tasks
    as it has splits.

    Quotes are counted per split; whether a quoted field is open at a split's start is the parity of those before it. So each task
    joins the lines of its splits to records by itself, and only the few pieces of records that cross an edge are put together
    by a shuffle."""
    ship_package(spark)
    lines = _split_lines(spark, path, lineSep="\n").withColumn("_quotes", F.length("value") - F.length(F.replace("value", F.lit('"'))))
    splits = _before(lines.groupBy("file", "_block", "split").agg(F.sum("_quotes").alias("_n")), "_n", "_off")
    splits = materialize(splits.select("split", (F.col("_off") % 2 == 1).alias("opened")), "csv-splits")
    rows = _with_splits(lines, splits).select("file", "_block", "_pos", F.col("value").cast("binary").alias("line"), "opened")
    found = materialize(rows.mapInArrow(_join_records, _RECORD), "csv-records")
    whole = found.filter("NOT _head AND NOT _tail").select("file", "_block", "_pos", "record")
    # a piece with a tail begins a record unless it has a head too; those that follow belong to it
    order = Window.partitionBy("file").orderBy("_block", "_pos")
    parts = found.filter("_head OR _tail").withColumn("_record", F.sum(F.when(F.col("_head"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = parts.groupBy("file", "_record").agg(F.min("_block").alias("_block"), F.min_by("_pos", "_block").alias("_pos"), F.array_sort(F.collect_list(F.struct("_block", "_pos", "record"))).alias("p"))
    joined = joined.select("file", "_block", "_pos", F.array_join(F.transform("p", lambda p: p["record"]), "\n").alias("record"))
    records = whole.unionByName(joined)
    heads = records.groupBy("file").agg(F.min(F.struct("_block", "_pos")).alias("_first")).withColumnRenamed("file", "_f")
    records = records.join(heads, F.col("file") == F.col("_f"))
    return records.select("file", F.regexp_replace("record", "\r$", "").alias("record"), ((F.col("_block") == F.col("_first._block")) & (F.col("_pos") == F.col("_first._pos"))).alias("is_first"))


def read_structured_csv(spark: SparkSession, path: str) -> DataFrame:
    """O-S3: a proper CSV with header (quoted fields, embedded newlines), split over tasks however large a file is."""
    rows = csv_records(spark, path).filter(~F.col("is_first") & (F.col("record") != ""))
    parsed = F.from_csv("record", F.lit(STRUCTURED_SCHEMA.simpleString()[7:-1].replace(":", " ")), {"escape": '"', "multiLine": "true"})
    return rows.select(parsed.alias("c")).select("c.*")


def parse_lenient(text: DataFrame, value: str = "value") -> DataFrame:
    """O-S4: split each line from the right on commas, at most 3 splits.

    4 parts → raw, event, template, ts; 3 → ts ''; fewer → padded with ''. Pure column
    expressions (split/slice/array_join), no Python.
    """
    parts = F.split(F.col(value), ",")
    k = F.size(parts)
    at = lambda i: F.get(parts, i)  # noqa: E731  (0-based, null past the end)
    raw = F.when(k >= 4, F.array_join(F.slice(parts, 1, k - 3), ",")).otherwise(at(0))
    ev = F.when(k >= 4, F.element_at(parts, k - 2)).when(k >= 2, at(1)).otherwise(F.lit(""))
    tpl = F.when(k >= 4, F.element_at(parts, k - 1)).when(k >= 3, at(2)).otherwise(F.lit(""))
    ts = F.when(k >= 4, F.element_at(parts, k)).otherwise(F.lit(""))
    return text.select("*", raw.alias("raw_log"), ev.alias("event_id"), tpl.alias("event_template"),
                       ts.alias("ts_text"))


def read_structured_lenient(spark: SparkSession, path: str) -> DataFrame:
    """O-S4 on files: header and blank lines dropped, typed time where it is one (ISO, with T or a space)."""
    t = spark.read.text(path).filter(is_nonblank("value") & (F.col("value") != HEADER))
    p = parse_lenient(t)
    return p.select("raw_log", "event_id", "event_template",
                    F.coalesce(*[F.try_to_timestamp(F.col("ts_text"), F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")])
                    .cast("timestamp_ntz").alias("ts"))


def conform(df: DataFrame) -> DataFrame:
    """The four structured columns, missing ones as ''."""
    cols = []
    for c in STRUCTURED_COLUMNS:
        cols.append((F.col(c).cast("string") if c in df.columns else F.lit("")).alias(c))
    return df.select(*cols)


def union_dedup(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Set union of two structured frames (the table after an append, O-S5 + O-D3)."""
    return conform(existing).dropDuplicates().unionByName(new_rows(existing, new))


def new_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` not yet in ``existing`` (distinct). Null-safe equality on all columns."""
    n = conform(new).dropDuplicates()
    e = conform(existing)
    cond = [n[c].eqNullSafe(e[c]) for c in STRUCTURED_COLUMNS]
    return n.join(e, cond, "left_anti")


#: Buckets of a structured table, by the hash of its rows.
TABLE_BUCKETS = 64


def row_key(columns=STRUCTURED_COLUMNS) -> F.Column:
    return F.xxhash64(*[F.coalesce(F.col(c), F.lit("")) for c in columns])


@contextmanager
def bucketed_table(spark: SparkSession, path: str, columns=STRUCTURED_COLUMNS, part: str = "ingest_date", buckets: int = TABLE_BUCKETS):
    """The name, in this session, of a table in ``path``: Parquet by ``part``, in buckets of the row's hash. ``columns`` are names of strings,
    or (name, type). The files say all that there is; the name is dropped at the end and the files stay."""
    name = f"structured_{uuid.uuid4().hex}"
    ddl = ", ".join(f"{c} string" if isinstance(c, str) else " ".join(c) for c in columns)
    spark.sql(f"CREATE TABLE {name} ({ddl}, row_key bigint, {part} string) USING parquet PARTITIONED BY ({part}) "
              f"CLUSTERED BY (row_key) SORTED BY (row_key) INTO {buckets} BUCKETS LOCATION '{path}'")
    try:
        if path_kind(spark, path) is not None:
            spark.sql(f"MSCK REPAIR TABLE {name}")
        yield name
    finally:
        spark.sql(f"DROP TABLE {name}")


def missing_rows(new: DataFrame, existing: DataFrame, columns=STRUCTURED_COLUMNS) -> DataFrame:
    """Distinct rows of ``new`` (with row_key) that ``existing`` has not. The hash is the only key of the anti join, so a
    bucketed ``existing`` is read bucket by bucket and never shuffled; the columns are compared beside it."""
    n = new.dropDuplicates(["row_key", *columns]).alias("n")
    e = existing.alias("e")
    cond = F.col("n.row_key") == F.col("e.row_key")
    for c in columns:
        a, b = F.col(f"n.{c}"), F.col(f"e.{c}")
        cond = cond & (((a >= b) & (a <= b)) | (a.isNull() & b.isNull()))
    return n.join(e, cond, "left_anti")


def append_structured(df: DataFrame, table_path: str, ingest_date: str | None = None) -> int:
    """O-S5: append only rows not already in the table; never rewrites or shuffles the table.

    The table is bucketed by the hash of its rows. New rows are shuffled to these buckets once, for the anti join with the table and for the
    write into the partition of ``ingest_date``. Re-running the same append adds 0 rows. Returns the number of
    rows written (via an observed metric).
    """
    spark = df.sparkSession
    date = ingest_date or dt.date.today().isoformat()
    from pyspark.sql import Observation
    obs = Observation("append")
    with bucketed_table(spark, table_path) as name:
        rows = missing_rows(conform(df).withColumn("row_key", row_key()), spark.table(name))
        rows = rows.withColumn("ingest_date", F.lit(date)).observe(obs, F.count(F.lit(1)).alias("rows"))
        rows.repartition(TABLE_BUCKETS, "row_key").select(*STRUCTURED_COLUMNS, "row_key", "ingest_date").write.insertInto(name)
    return int(obs.get.get("rows", 0))


def write_provenance(df: DataFrame, root: str, source: str, uploader: str | None = None,
                     ingest_ts: dt.datetime | None = None) -> dict:
    """O-S6: one immutable structured copy per ingest plus one metadata row.

    Data goes to ``root/data/source=<s>/ingest_id=<id>`` and the metadata row (source,
    uploader, ingest time, rows) is appended to ``root/ingests``. The row count comes from
    an observed metric of the single write, not from a second pass.
    """
    from pyspark.sql import Observation
    spark = df.sparkSession
    ingest_ts = ingest_ts or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    ingest_id = f"{source}_structured_{ingest_ts.strftime('%Y%m%dT%H%M%SZ')}"
    obs = Observation("provenance")
    out = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    path = os.path.join(root, "data", f"source={source}", f"ingest_id={ingest_id}")
    out.write.mode("errorifexists").parquet(path)
    rows = int(obs.get.get("rows", 0))
    meta = spark.createDataFrame(
        [(ingest_id, source, uploader, ingest_ts, rows, path)],
        "ingest_id string, source string, uploader string, ingest_ts timestamp_ntz, rows bigint, path string")
    meta.write.mode("append").parquet(os.path.join(root, "ingests"))
    return {"ingest_id": ingest_id, "source": source, "uploader": uploader,
            "ingest_time": ingest_ts.isoformat() + "Z", "rows": rows, "path": path}


def _copies(spark: SparkSession, data: str) -> list[tuple]:
    """(source, ingest_id, mtime, path) of every copy's folder, from the folder listing alone."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(os.path.join(data, "source=*", "ingest_id=*"))
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    out = []
    for f in found:
        p = f.getPath()
        out.append((p.getParent().getName().split("=", 1)[1], p.getName().split("=", 1)[1], dt.datetime.fromtimestamp(f.getModificationTime() / 1000, dt.timezone.utc).replace(tzinfo=None), p.toString()))
    return out


def list_provenance(spark: SparkSession, root: str, limit: int = 20) -> DataFrame:
    """O-S7: latest ``limit`` ingests by time (ties by id): every copy with its rows and modification
    time, and its metadata if there is any (a run that dies before it writes them is listed too).

    Rows come from the metadata. Only copies that have none are opened, and of these only the footers: no data column is read."""
    data, ingests = os.path.join(root, "data"), os.path.join(root, "ingests")
    schema = "ingest_id string, source string, uploader string, ingest_ts timestamp_ntz, rows bigint, path string"
    meta = spark.createDataFrame([], schema) if path_kind(spark, ingests) is None else spark.read.schema(schema).parquet(ingests)
    copies = spark.createDataFrame(_copies(spark, data), "source string, ingest_id string, mtime timestamp_ntz, _path string")
    bare = [r["_path"] for r in copies.join(meta, ["source", "ingest_id"], "left_anti").collect()]
    if bare:
        read = spark.read.option("basePath", data).parquet(*bare).groupBy("source", "ingest_id").agg(F.count(F.lit(1)).alias("_rows"))
    else:
        read = spark.createDataFrame([], "source string, ingest_id string, _rows bigint")
    x = meta.join(copies.drop("_path"), ["source", "ingest_id"], "full").join(read, ["source", "ingest_id"], "left")
    x = x.withColumn("rows", F.coalesce("rows", "_rows")).withColumn("has_metadata", F.col("path").isNotNull()).drop("_rows")
    return x.orderBy(F.coalesce("ingest_ts", "mtime").desc(), F.col("ingest_id")).limit(limit)


def preview(spark: SparkSession, root: str, ingest_id: str, n: int = 50, order: str = "line_no") -> DataFrame:
    """O-S8: first ``n`` rows of one ingest (partition-pruned read)."""
    data = spark.read.parquet(os.path.join(root, "data"))
    x = data.filter(F.col("ingest_id") == ingest_id)
    return x.orderBy(order).limit(n) if order in x.columns else x.limit(n)


