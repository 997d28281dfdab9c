"""The derived views match the numbers stated in FIXTURES.md §3 (sf0.01)."""

from pyspark.sql import functions as F

from logsift.functions.lines import is_noise
from logsift.functions.scores import alert_level
from logsift.plans.registry import doc_lines, lines, scores

from conftest import SF_MID


def test_score_series_counts(spark):
    s = scores(spark, SF_MID)
    assert s.count() == 960
    levels = {r["level"]: r["count"] for r in s.groupBy(alert_level("score").alias("level")).count().collect()}
    assert {k: v for k, v in levels.items() if k != "NORMAL"} == {"CRITICAL": 76, "HIGH": 105, "MEDIUM": 80, "LOW": 90}
    mm = s.agg(F.min("score"), F.max("score")).first()
    assert round(mm[0], 4) == -0.9997 and round(mm[1], 3) == 0.938


def test_log_lines_counts(spark):
    x = lines(spark, SF_MID)
    assert x.count() == 10000 and x.select("raw_log").distinct().count() == 9159
    assert x.filter(is_noise("raw_log")).count() == 1982


def test_document_lines_counts(spark):
    d = doc_lines(spark, SF_MID)
    assert d.count() == 9344 and d.select("line").distinct().count() == 7611
