import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from logsift.llm import multiset as M
from logsift.llm import queries as Q

from llm_data import SF_MID, SF_SMALL, nothing, odd, odd_rows, texts  # noqa: F401
from oracle import compare

MOD = 1 << 32


def vector(text):
    """Brute force: the lanes of a text in Python integers."""
    out = [0] * M.LANES
    for line in (text or "").split("\n"):
        if line:
            d = hashlib.sha256(line.encode()).hexdigest()
            for j in range(8):
                out[1 + j] = (out[1 + j] + int(d[8 * j : 8 * j + 8], 16)) % MOD
    for unit in re.findall(M.UNIT, text or ""):
        d = hashlib.md5(unit.encode()).hexdigest()
        out[0] += 1
        for j in range(4):
            w = int(d[8 * j : 8 * j + 8], 16)
            for i in range(32):
                out[9 + 32 * j + i] += w >> i & 1
    return out


def near(v, w):
    s, t = ([float(2 * c - x[0]) for c in x[9:]] for x in (v, w))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    both = dot(s, s) * dot(t, t)
    return 1.0 if v == w else 0.0 if not both else min(1.0, max(0.0, dot(s, t)) / math.sqrt(both))


def edits(rows):
    """Brute force: the query's rows, next documents in order of falling ids."""
    hex_of = lambda v: "".join(f"{x:08x}" for x in v)
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = set()
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        v, w = vector(t), vector(edited)
        out.add((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hex_of(v), hex_of(w), near(v, w), near(v, vector(after))))
    return out


def found(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_equals_sql(spark, sf):
    assert compare(spark, "op12", *Q.ENTRIES["op12_multiset"], sf)[1] == []


@pytest.mark.parametrize("ids", ["dense", "skewed", "one", "two"])
def test_rows_equal_brute_force(spark, texts, ids):
    rows = {"dense": texts, "skewed": [((i * i * i) - 10**6, t) for i, t in texts] + [((1 << 63) - 1, "top"), (-(1 << 63), None)], "one": texts[:1], "two": texts[:2]}[ids]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(M.compare_edits(df)) == edits(rows)


def test_order_insertion_and_deletion(spark):
    rows = [("ab", "a b c\nd e. f\n"), ("ba", "d e. f\n\na b c"), ("b", "d e. f"), ("a", "a b c"), ("aab", "a b c\na b c\nd e. f"), ("none", None), ("empty", ""), *((f"many{k}", "\n".join(f"w{i % 7} x." for i in range(k))) for k in (126, 127, 128, 255, 1000))]
    v = {r.k: r.vector for r in M.fingerprints(spark.createDataFrame(rows, "k string, text string"), "k").collect()}
    assert all(v[k] == vector(t) for k, t in rows)
    assert v["ab"] == v["ba"] != v["aab"] and v["none"] == v["empty"] == [0] * M.LANES
    one = spark.createDataFrame([(v["a"], v["b"], v["ab"], v["aab"])], "a array<long>, b array<long>, ab array<long>, aab array<long>")
    got = one.select(M.insert(F.col("a"), F.col("b")), M.remove(F.col("aab"), F.col("a")), M.remove(F.col("ab"), F.col("a")), M.remove(F.col("a"), F.col("aab"))).first()
    assert got[0] == v["ab"] and got[1] == v["ab"] and got[2] == v["b"]
    assert [(x + y) % MOD for x, y in zip(got[3], v["aab"], strict=True)] == v["a"]
    groups = M.merged(M.fingerprints(spark.createDataFrame(rows, "k string, text string"), "k").withColumn("g", F.col("k").isin("a", "b")), ["g"])
    assert {r.g: r.vector for r in groups.collect()}[True] == v["ab"]


def test_likeness_follows_shared_paragraphs(spark):
    line = lambda k: f"line {k} has its own words w{k} and x{k} here"
    text = lambda ks: "\n".join(line(k) for k in ks)
    rows = [(s, text(range(400)), text([*range(s), *range(1000, 1400 - s)])) for s in (0, 100, 200, 300, 399)]
    df = spark.createDataFrame(rows, "shared int, a string, b string")
    df = M.with_vector(M.with_vector(df, F.col("a"), "va"), F.col("b"), "vb")
    got = {r.shared: r.x for r in df.select("shared", M.likeness(F.col("va"), F.col("vb")).alias("x")).collect()}
    assert all(abs(got[s] - s / 400) < 0.25 for s in got) and got[399] > 0.98


def test_repeated_and_missing_ids_keep_every_row(spark, odd, nothing):
    rows = M.compare_edits(odd).collect()
    assert len(rows) == len(odd_rows()) and sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in odd_rows())
    by_text = {}
    for r in rows:
        by_text.setdefault((r.n_chars, r.fingerprint), set()).add(r.doc_id)
    assert {3, 4} in by_text.values() and {5, 6} in by_text.values()
    assert M.compare_edits(nothing).collect() == []
    # a third of all rows has one id: they are dealt out by their texts, and each row has one next row
    hot = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 11 = 0 THEN NULL ELSE id END AS doc_id", "concat('text ', id) AS text")
    assert M._in_buckets(hot.withColumnRenamed("doc_id", "id"), M.BUCKET_BYTES, 16).filter("id = 7").groupBy("bucket").count().agg(F.max("count")).first()[0] < 60
    nexts = M.with_next(hot, [], least=16).select("text", "next.text").collect()
    order = sorted(hot.withColumn("h", F.xxhash64("text")).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    assert {(a, b) for a, b in nexts} == {(a.text, b.text) for a, b in zip(order, order[1:] + order[:1], strict=True)} and len(nexts) == 3000


def test_no_python_in_the_plan(spark):
    plan = Q.op12_multiset(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
