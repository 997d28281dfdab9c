import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.llm import quality as B
from logsift.llm import queries as Q
from logsift.operators.quantile import exact_percentile

from llm_data import SF_MID, SF_SMALL, nothing, odd  # noqa: F401


def test_held_out_accuracy_and_contract(spark):
    rows = Q.op1_quality(spark, SF_MID).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.93
    assert np.mean([p for p, y in held if y == 1]) > 0.93


def test_only_rows_that_are_not_held_out_teach(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (B.learn(docs, x) for x in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold
    again = B.learn(docs.repartition(7), labels.repartition(3))
    assert np.allclose(a.weights, again.weights, atol=1e-6)


def test_pairs_rank_and_quantile():
    draw = np.random.default_rng(0)
    y = (draw.random(400) < 0.8).astype(int)
    x = draw.standard_normal((400, 5)) + np.outer(y, [3, 0, 0, 0, 0])
    m = B.fit(x, y)
    s = m.score(x)
    assert (s[y == 1][:, None] > s[y == 0][None]).mean() > 0.95
    assert abs((s < B.CUT).mean() - (y == 0).mean()) < 0.01


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, 1, 0), (6, 0, 0), (6, 0, 0), (20, None, 0), (None, 1, 0), (21, 7, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    rows = B.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    same = {}
    for r, t in zip(B.score(odd, labels, keep=True).collect(), [None] * len(rows), strict=True):
        assert same.setdefault(r.row.text or "", r.score) == r.score
    assert B.good_only(odd, labels).columns == odd.columns
    one_kind = labels.filter("quality = 1")
    assert {r.score for r in B.score(odd, one_kind).collect()} == {B.CUT}
    assert B.good_only(odd, labels.limit(0)).count() == odd.count()
    assert B.score(nothing, labels).collect() == []


def labelled(spark, at):
    docs = spark.read.parquet(f"{at}/documents.parquet")
    labels = spark.read.parquet(f"{at}/labels.parquet")
    own = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    return docs, labels, own


def test_threshold_covers_all_labelled_rows(spark):
    docs, labels, own = labelled(spark, SF_MID)
    m = B.learn(docs, labels, sample=40)
    rows = [(m.worth(B.features((r.text or "").encode())[None])[0], own[r.doc_id]) for r in docs.collect() if r.doc_id in own]
    assert len(rows) > 4 * 40
    worth, zero = np.array([w for w, _ in rows]), np.mean([y == 0 for _, y in rows])
    assert m.threshold == pytest.approx(np.quantile(worth, zero), rel=1e-12)
    assert abs((worth < m.threshold).mean() - zero) <= 1 / len(rows)


def test_repeated_ids_teach_alike_in_any_order(spark):
    docs, labels, _ = labelled(spark, SF_SMALL)
    again = docs.crossJoin(spark.range(5)).withColumn("text", F.concat("text", F.repeat(F.lit(" again"), F.col("id").cast("int")))).drop("id")
    a, b = (B.learn(again.repartition(n), labels, sample=60) for n in (1, 7))
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold
    c = B.learn(again.unionByName(again).repartition(5), labels, sample=60)  # copies teach once
    assert np.array_equal(a.weights, c.weights)


def test_equal_scores_stand_at_the_threshold(spark):
    df = spark.range(20_001).select(F.when(F.col("id") < 10_000, F.col("id") - 30_000).when(F.col("id") > 10_002, F.col("id")).otherwise(0.123456789).alias("v"))
    assert exact_percentile(df, "v", 10_000.21 / 20_000) == 0.123456789
