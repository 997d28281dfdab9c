"""Appends, ingest listing and text readers against brute force, and the plans that make them cheap."""

import csv
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logsift.sources import text as TX


def structured(spark, ids, tag="r"):
    return spark.createDataFrame([(f"{tag}{i}", str(i % 3) if i % 4 else None, "t", "2024") for i in ids], "raw_log string, event_id string, event_template string, ts string")


def test_append_adds_only_new_rows_and_never_shuffles_the_table(spark, tmp_path):
    path = str(tmp_path / "table")
    assert TX.append_structured(structured(spark, [*range(100), *range(50)]), path, "2024-01-01") == 100
    assert TX.append_structured(structured(spark, range(100)), path, "2024-01-02") == 0
    assert TX.append_structured(structured(spark, range(60, 130)), path, "2024-01-02") == 30
    rows = spark.read.parquet(path)
    assert rows.count() == 130 == rows.select("raw_log").distinct().count()
    assert {r["ingest_date"].isoformat() if isinstance(r["ingest_date"], dt.date) else r["ingest_date"]: r["count"] for r in rows.groupBy("ingest_date").count().collect()} == {"2024-01-01": 100, "2024-01-02": 30}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with TX.bucketed_table(spark, path) as name:
            new = TX.conform(structured(spark, range(200))).withColumn("row_key", TX.row_key())
            out = TX.missing_rows(new, spark.table(name))
            assert out.count() == 70
            plan = out._jdf.queryExecution().sparkPlan().toString(), out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Bucketed: true" in plan[1] and "LeftAnti" in plan[1]
    table_side = plan[1][plan[1].index("LeftAnti"):].split("FileScan")[0].rsplit("+- ", 4)
    assert not any("Exchange" in x for x in table_side[-3:])


def test_listing_opens_only_copies_without_metadata(spark, tmp_path):
    root = str(tmp_path / "root")
    for k in range(3):
        TX.write_provenance(structured(spark, range(10 * k + 1)), root, "src", "me", dt.datetime(2024, 1, 1 + k))
    structured(spark, range(7)).write.parquet(f"{root}/data/source=src/ingest_id=lost")  # its run died before the metadata
    got = {r.ingest_id: (r.rows, r.has_metadata) for r in TX.list_provenance(spark, root).collect()}
    assert got == {"lost": (7, False), **{f"src_structured_2024010{1 + k}T000000Z": (10 * k + 1, True) for k in range(3)}}
    x = TX.list_provenance(spark, root)
    x.collect()
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan and "raw_log" not in plan
    assert {f.split("/")[-2] for f in x.inputFiles() if "/data/" in f} == {"ingest_id=lost"}
    assert [r.ingest_id for r in TX.list_provenance(spark, root, 1).collect()] == ["lost"]


@pytest.fixture
def small_splits(spark):
    """File splits of 300 bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_line_numbers_without_a_shuffle_of_the_text(spark, tmp_path, small_splits, monkeypatch):
    draw = random.Random(2)
    want = set()
    for f in ("a.log", "b.log"):
        lines = [draw.choice(["", " ", f"line {k} of {f} " + "x" * draw.randint(0, 90)]) for k in range(200)]
        (tmp_path / f).write_text("\n".join(lines) + "\n")
        want |= {(f, k, x.strip()) for k, x in enumerate(lines) if x.strip()}
    x = TX.read_logs(spark, str(tmp_path))
    assert {(r.file.split("/")[-1], r.line_no, r.raw_log) for r in x.collect()} == want
    assert x.rdd.getNumPartitions() > 20
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(TX, "MOST_SPLITS", 0)  # the other way
    monkeypatch.setattr(TX._with_splits, "__defaults__", (0,))
    assert {(r.file.split("/")[-1], r.line_no, r.raw_log) for r in TX.read_logs(spark, str(tmp_path)).collect()} == want


def test_one_quoted_csv_is_read_by_many_tasks(spark, tmp_path, small_splits):
    """Line breaks, quotes and commas in fields, records longer than several splits, at every offset."""
    draw = random.Random(4)
    field = lambda n: "".join(draw.choice(["a", ",", "\n", '"', " b", "\r\n", "é"]) for _ in range(n))
    for name, size in (("a", 8), ("b", 60), ("c", 2000)):
        rows = [["r" + field(draw.randint(0, size)) + "r", str(k), "t" + field(draw.randint(0, 3)) + "t", "2024"] for k in range(60 if size < 1000 else 8)]
        folder = tmp_path / name
        folder.mkdir()
        with open(folder / "part.csv", "w", newline="") as f:
            w = csv.writer(f, lineterminator="\n", quoting=csv.QUOTE_ALL if size == 60 else csv.QUOTE_MINIMAL)
            w.writerow(["raw_log", "event_id", "event_template", "ts"])
            w.writerows(rows)
        got = TX.read_structured_csv(spark, str(folder))
        norm = lambda x: x.replace("\r\n", "\n")  # noqa: E731  the parser's line breaks
        assert sorted((int(r.event_id), norm(r.raw_log), norm(r.event_template), r.ts) for r in got.collect()) == sorted((int(k), norm(a), norm(t), ts) for a, k, t, ts in rows)
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 3
