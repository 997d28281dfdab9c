import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logsift.llm import linededup as L
from logsift.llm import queries as Q

from llm_data import SF_MID, nothing, odd  # noqa: F401
from oracle import compare


def brute(rows, min_docs, min_chars=1):
    docs = defaultdict(set)
    key = lambda x: x.encode().strip().lower().decode()
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs[key(line)].add(i)
    gone = {k for k, d in docs.items() if len(k) >= min_chars and len(d) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.id, r.n_lines, r.n_dropped, r.kept_text or "") for r in df.collect()), key=str)


def test_query_equals_sql(spark):
    assert compare(spark, "op8", *Q.ENTRIES["op8_line_dedup"], SF_MID)[1] == []


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert result(L.dedup_lines(odd)) == brute(rows, 10)
    assert result(L.dedup_lines(odd, min_docs=2, min_chars=4)) == brute(rows, 2, 4)
    assert L.dedup_lines(nothing).collect() == []
    got = L.dedup_lines(odd)
    assert got.select("row.`a.b`", "row.keep").distinct().collect() == odd.select("`a.b`", "keep").distinct().collect()


def test_null_text_stays_null_and_counts_one_line(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    r = L.dedup_lines(df).first()
    assert (r.kept_text, r.n_lines, r.n_dropped) == (None, 1, 0)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_hot_lines_over_partition_edges(spark, parts):
    """A line in every document and lines in 1 to 20 documents, whatever the partitions cut."""
    draw = random.Random(parts)
    rows = [(i, "\n".join(["hot"] * 3 + [f"l{j}" for j in range(40) if draw.random() < j / 40] + [f"own {i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert result(L.dedup_lines(df)) == brute(rows, 10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_stream_over_batches(size):
    """The streaming pass finds the same keys whatever the batches; only edge keys are unsure."""
    draw = random.Random(size)
    rows = sorted((draw.randrange(12), 0, draw.randrange(30), 0) for _ in range(400))
    rows = sorted(set(rows))
    table = pa.table({"h1": [r[0] for r in rows], "h2": [r[1] for r in rows], "id": [r[2] for r in rows], "text_key": [r[3] for r in rows], "n_lines": pa.array([1] * len(rows), pa.int32()), "places": pa.array([b"\0\0\0\0"] * len(rows))})
    for limit in (3, 25, 31):
        out = [x for b in L._stream_common(limit)(iter(table.to_batches(max_chunksize=size))) for x in b.to_pylist()]
        docs = defaultdict(set)
        for r in rows:
            docs[r[0]].add(r[2])
        sure = {k for k, d in docs.items() if len(d) >= limit}
        assert {x["h1"] for x in out if x["sure"]} == sure
        assert {x["h1"] for x in out if not x["sure"]} <= {rows[0][0], rows[-1][0]} - sure
        assert sorted((x["h1"], x["id"]) for x in out if x["sure"]) == [(r[0], r[2]) for r in rows if r[0] in sure]


def test_bitmaps(spark):
    rows = [(i, "common\nown %d\ncommon" % i) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = L.keep_bitmaps(df).collect()
    assert len(got) == 10
    assert all(L.unpack(r.keep, r.n_lines).tolist() == [False, True, False] and r.n_dropped == 2 for r in got)


def test_query_columns(spark):
    df = Q.op8_line_dedup(spark, SF_MID)
    assert df.filter((F.col("n_dropped") > 0)).count() > 0


def test_one_row_repeated_often(spark):
    """A third of all rows is one row: its group holds its lines once, and every copy gets the same bitmap."""
    docs = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'common\\nown\\ncommon' ELSE concat('common\\n', id) END AS text")
    assert [tuple(r) for r in L.keep_bitmaps(docs).filter("id = -1").select("n_lines", "n_dropped").collect()] == [(3, 2)]
    got = L.dedup_lines(docs).groupBy("kept_text").count().orderBy(F.desc("count")).first()
    assert tuple(got) == ("own", 3000)


def test_texts_are_put_together_a_few_at_a_time():
    """However many rows an Arrow batch has, a task holds the new texts of a few of them."""
    import pyarrow as pa

    from logsift.llm.linededup import ROWS, _applied

    n = 3 * ROWS + 1
    b = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["a\nb"] * n), pa.array([None] * n, pa.binary())], names=["id", "text", "keep"])
    out = list(_applied(iter([b])))
    assert [o.num_rows for o in out] == [ROWS, ROWS, ROWS, 1]
    assert [r["id"] for o in out for r in o.to_pylist()] == list(range(n))
    assert {(r["kept_text"], r["n_lines"], r["n_dropped"]) for o in out for r in o.to_pylist()} == {("a\nb", 2, 0)}
