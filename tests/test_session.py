"""Scratch tables go under the session's spark.checkpoint.dir; scans are spread by a setting only."""

import os

from logsift.session import SCAN_PARTITIONS, ensure_checkpoint_dir, materialize, path_kind, scratch_path, table

from conftest import SF_SMALL


def test_scratch_under_checkpoint_dir(spark):
    base = ensure_checkpoint_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir") == base
    p = scratch_path(spark, "x")
    assert p.startswith(base) and os.path.dirname(p) == base.rstrip("/")
    df = materialize(spark.range(5), "t")
    from urllib.parse import urlparse
    assert df.count() == 5 and urlparse(df.inputFiles()[0]).path.startswith(urlparse(base).path)


def test_scans_are_spread_by_the_setting_only(spark):
    n = spark.conf.get(SCAN_PARTITIONS)
    assert table(spark, SF_SMALL, "events").rdd.getNumPartitions() == int(n) == 8
    spark.conf.unset(SCAN_PARTITIONS)
    try:
        plan = table(spark, SF_SMALL, "events")._jdf.queryExecution().toString()
        assert "Repartition" not in plan and "Exchange" not in plan
    finally:
        spark.conf.set(SCAN_PARTITIONS, n)


def test_path_kind(spark, tmp_path):
    (tmp_path / "f").write_text("x")
    assert [path_kind(spark, str(tmp_path / p)) for p in ("", "f", "none")] == ["dir", "file", None]


def test_models_too_large_for_a_task_are_refused(spark, monkeypatch):
    import pytest

    from logsift import session
    assert session.share(spark, [1], 8, "a model").value == [1]
    monkeypatch.setattr(session, "MOST_SHARED", 100)
    with pytest.raises(ValueError, match="a model takes 101 bytes"):
        session.share(spark, [1], 101, "a model")
