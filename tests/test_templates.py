"""Template mining invariants and sanitise / de-duplicate."""

import datetime as dt
import random

import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from logsift.operators import sanitize as D
from logsift.operators import templates as TM
from logsift.operators.templates import PARAM, _merge_bucket
from logsift.plans.registry import clean_lines, doc_lines, q_doc_signatures, q_doc_templates
from logsift.functions import lines as L

from conftest import SF_MID, SF_SMALL


def test_merge_bucket():
    sigs = ["open file a ok", "open file b ok", "open port c ok", "close all now please"]
    out = _merge_bucket(sigs, 0.4)
    assert out[0] == out[1] == out[2] == f"open {PARAM} {PARAM} ok"
    assert out[3] == "close all now please"


def test_signature_drops_leading_time(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05 ERROR: block 17 failed",), ("1704164645 x 1",)], "raw_log string")
    got = [r["signature"] for r in TM.with_signature(df).collect()]
    assert got == [f"ERROR: block {PARAM} failed", f"x {PARAM}"]


def test_every_line_matches_its_template(spark):
    d = doc_lines(spark, SF_SMALL).filter(L.is_nonblank("line")).withColumn("raw_log", L.mask_sensitive("line"))
    d = d.withColumn("line_no", F.col("doc_id") * 100000 + F.col("line_idx"))
    t = TM.mine_templates(TM.signatures(d))
    a = TM.with_signature(TM.assign_templates(d, t).withColumnRenamed("signature", "_s"))
    ok = a.select(F.forall(F.zip_with(F.split("event_template", " "), F.split("signature", " "),
                                      lambda x, y: (x == F.lit(PARAM)) | (x == y)), lambda b: b).alias("ok"))
    assert ok.filter(~F.col("ok")).count() == 0


def test_mining_is_order_independent(spark):
    c = clean_lines(spark, SF_MID)
    a = {(r["signature"], r["event_template"]) for r in TM.mine_templates(TM.signatures(c)).collect()}
    b = {(r["signature"], r["event_template"]) for r in
         TM.mine_templates(TM.signatures(c.repartition(13, "raw_log").orderBy(F.rand(3)))).collect()}
    assert a == b


def test_sanitize_and_dedupe(spark):
    ingest = dt.datetime(2024, 2, 1)
    rows = [(1, "a", None, "2024-01-01 00:00:00"), (2, "a", None, "bad"), (3, "  ", "7", None), (4, "b", "7", None)]
    df = spark.createDataFrame(rows, "line_no long, raw_log string, event_id string, ts string")
    s = D.sanitize(df, ingest)
    got = sorted(tuple(r) for r in s.select("line_no", "event_id", "event_template", "ts").collect())
    assert got == [(1, "unknown", "unknown", dt.datetime(2024, 1, 1)), (2, "unknown", "unknown", ingest),
                   (4, "7", "unknown", ingest)]
    first = D.dedupe_first(s).orderBy("line_no").collect()
    assert [r["line_no"] for r in first] == [1, 4]


def test_mining_single_bucket_partitions(spark):
    # one shape per partition: every batch holds only an open bucket
    sig = spark.createDataFrame([(2, "a", "a x", 3), (2, "b", "b y", 1), (3, "a", "a b c", 1)],
                                "n_tokens long, first_token string, signature string, support long")
    got = {r["signature"]: r["event_template"] for r in TM.mine_templates(sig.repartition(3)).collect()}
    assert got == {"a x": "a x", "b y": "b y", "a b c": "a b c"}


def test_mining_independent_of_batch_size(spark):
    d = doc_lines(spark, SF_SMALL).filter(L.is_nonblank("line")).withColumn("raw_log", L.mask_sensitive("line"))
    sig = TM.signatures(d).persist()
    a = {(r["signature"], r["event_template"]) for r in TM.mine_templates(sig).collect()}
    # small Arrow batches: buckets span many batches
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        b = {(r["signature"], r["event_template"]) for r in TM.mine_templates(sig).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert a == b and len(a) == sig.count()
    assert a == brute(sig.select("n_tokens", "first_token", "signature", "support").collect())


def brute(rows, similarity=0.4):
    """Leader clustering in plain Python: (signature, template)."""
    buckets = {}
    for r in rows:
        buckets.setdefault((r.n_tokens, r.first_token), []).append((-r.support, xxhash.xxh64_intdigest(r.signature.encode(), 42), r.signature))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    out = set()
    for (n, _), shapes in buckets.items():
        led = []  # [tokens of the leader, members]
        for _, _, sig in sorted((d, signed(h), s) for d, h, s in shapes):
            tok = sig.split(" ")
            like = [sum(x == y != PARAM for x, y in zip(tok, leader)) for leader, _ in led]
            best = max(range(len(led)), key=lambda k: (like[k], -k), default=None)
            if best is not None and like[best] / n >= similarity:
                led[best][1].append(tok)
            else:
                led.append((tok, [tok]))
        for _, members in led:
            text = " ".join(c[0] if len(set(c)) == 1 else PARAM for c in zip(*members))
            out |= {(" ".join(m), text) for m in members}
    return out


def mined(sig, **kw):
    rows = TM.mine_templates(sig, **kw).collect()
    got = {(r["signature"], r["event_template"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_doc_templates_equal_brute_force(spark):
    want = brute(q_doc_signatures(spark, SF_MID).collect())
    assert {(r["signature"], r["event_template"]) for r in q_doc_templates(spark, SF_MID).collect()} == want


@pytest.mark.parametrize("n", [2, 5, 9, 30])
def test_index_joins_equal_brute_force(spark, n):
    """Every bucket by joins: random tokens with hot ones and parameters, so that shapes chain, tie and cluster."""
    draw = random.Random(n)
    words = [[f"p{k}w{i}" for i in range(12)] + [PARAM] for k in range(n)]
    pick = lambda k: words[k][min(12, int(draw.expovariate(0.3)))]
    sigs = {" ".join([draw.choice(["first", "other", PARAM])] + [pick(k) for k in range(1, n)]) for _ in range(400)}
    rows = [(n, s.split(" ")[0], s, draw.choice([1, 1, 2, 9])) for s in sorted(sigs)]
    sig = spark.createDataFrame(rows, "n_tokens long, first_token string, signature string, support long").repartition(5)
    want = brute(sig.collect())
    assert mined(sig, small=0) == want == mined(sig)


def test_one_bucket_of_many_shapes(spark):
    """200,000 shapes of one bucket that do not merge, and a third as many of one template: no task holds the bucket."""
    n = 200_000
    x = spark.range(n).selectExpr("concat('start ', 'a', id % 40, ' b', id div 1000, ' c', id, ' d', id % 977, ' e', id, ' f', id % 7, ' end', id % 3) AS signature")
    y = spark.range(n // 3).selectExpr("concat('start user u', id, 'x on host h', id % 100, 'y today now') AS signature")
    sig = x.unionByName(y).selectExpr("8L AS n_tokens", "'start' AS first_token", "signature", "1L AS support")
    sig = sig.filter(F.size(F.split("signature", " ")) == 8)
    t = TM.mine_templates(sig).persist()
    assert t.count() == sig.count()
    assert t.filter("signature LIKE 'start user%'").select("event_template").distinct().count() == 1
    # what follows a leader is like it, and leaders of this bucket are not like each other where they share their rarest tokens
    assert t.filter(~F.forall(F.zip_with(F.split("event_template", " "), F.split("signature", " "), lambda a, b: (a == PARAM) | (a == b)), lambda ok: ok)).count() == 0


def test_large_buckets_are_compared_by_their_rare_features():
    """A bucket far over the size that was one task's before, of shapes that are seldom alike: the template of every shape as by comparing
    it with all leaders, with few comparisons."""
    draw = random.Random(3)
    sigs = list(dict.fromkeys(" ".join(["the", *(f"w{min(400, int(draw.expovariate(0.01)))}" for _ in range(5)), "of", PARAM]) for _ in range(3000)))
    want = dict(brute([Row(n_tokens=8, first_token="the", signature=s, support=1) for s in sigs]))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(sigs, key=lambda s: (signed(xxhash.xxh64_intdigest(s.encode(), 42)), s))
    assert dict(zip(order, _merge_bucket(order, 0.4))) == want
    assert TM.SMALL >= 1 << 16


def test_mining_and_assigning_read_lines_cleaned_once(spark):
    c = clean_lines(spark, SF_SMALL)
    a, t = TM.mine_and_assign(c)
    assert "regexp" not in a._jdf.queryExecution().optimizedPlan().toString().lower()  # cleaned and cut already
    want = TM.assign_templates(c, TM.mine_templates(TM.signatures(c)))
    cols = ["line_no", "raw_log", "event_id", "event_template"]
    assert a.select(cols).exceptAll(want.select(cols)).isEmpty() and a.count() == want.count()
