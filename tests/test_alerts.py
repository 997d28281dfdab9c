"""Alert machine: golden rows, the sorted pass equals the machine, FIXTURES counts."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from logsift.operators import alerts as A
from logsift.plans.registry import scores

from conftest import SF_MID

T0 = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    data = [(srv, i, T0 + dt.timedelta(seconds=s), float(sc)) for i, (srv, s, sc) in enumerate(rows)]
    return spark.createDataFrame(data, "server_id string, window_id long, ts timestamp_ntz, score double")


def decisions(df):
    return [(r["window_id"], r["decision"]) for r in df.orderBy("window_id").collect()]


def test_golden_throttle_suppress(spark):
    rows = [("s", 0, -0.95), ("s", 299, -0.95), ("s", 300, -0.95), ("s", 3600, -0.95), ("s", 3601, -0.95)]
    out = A.generate_alerts(frame(spark, rows), 300, 3600, keep_dropped=True)
    assert decisions(out) == [(0, "emitted"), (1, "dropped"), (2, "suppressed"), (3, "suppressed"), (4, "emitted")]


def test_other_key_moves_clock(spark):
    rows = [("s", 0, -0.95), ("s", 300, -0.75), ("s", 599, -0.95), ("s", 600, -0.95)]
    out = A.generate_alerts(frame(spark, rows), 300, 3600, keep_dropped=True)
    # HIGH at 300 is another key: emitted, and the next CRITICAL is throttled from 300
    assert decisions(out) == [(0, "emitted"), (1, "emitted"), (2, "dropped"), (3, "suppressed")]


def test_messages(spark):
    rows = [("srv", 0, -0.1235), ("srv", 10, -0.95)]
    df = frame(spark, rows).withColumn("score", F.when(F.col("window_id") == 0, -0.95).otherwise(-0.95))
    df = df.withColumn("root_cause", F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")))
    out = A.generate_alerts(df, 0, 3600).orderBy("window_id").collect()
    assert out[0]["message"] == "[CRITICAL] Anomaly detected on srv (score: -0.950). Top events: a, b, c"
    assert out[1]["message"] == "Anomaly detected on srv" and out[1]["suppressed"]


def test_recent_alerts_limit_before_filter(spark):
    rows = [("s", 0, -0.8), ("s", 10, -0.35), ("s", 20, -0.35)]
    alerts = A.generate_alerts(frame(spark, rows), 0, 0)
    assert A.recent_alerts(alerts, 2, "HIGH").count() == 0
    assert A.recent_alerts(alerts, 3, "HIGH").count() == 1


def test_streamed_rows_equal_the_machine(spark):
    rng = random.Random(7)
    rows, servers = [], ["a", "b", "c"]
    for srv in servers:
        t = 0
        for _ in range(120):
            t += rng.choice([1, 299, 300, 301, 3599, 3600, 3601, 5000, 30])
            rows.append((srv, t, rng.choice([-0.95, -0.75, -0.55, -0.35, 0.2])))
    df = frame(spark, rows)
    got = {r["window_id"]: r["decision"] for r in A.generate_alerts(df, 300, 3600, keep_dropped=True).collect()}
    want = {}
    for srv in servers:
        mine = [(i, s, sc) for i, (sv, s, sc) in enumerate(rows) if sv == srv and sc <= -0.3]
        levels = ["CRITICAL" if sc <= -0.9 else "HIGH" if sc <= -0.7 else "MEDIUM" if sc <= -0.5 else "LOW"
                  for _, _, sc in mine]
        d = A.run_machine(np.array([s * 1_000_000 for _, s, _ in mine]), np.array(levels), 300_000_000,
                          3_600_000_000)
        want.update({i: x for (i, _, _), x in zip(mine, d)})
    assert got == want


def test_episodes_split_series_without_changing_decisions(spark):
    """Many episodes a server, cuts of time that they cross, equal times, and settings from none to long."""
    rng = random.Random(11)
    rows = []
    for srv in ("a", "b", None):
        t = 0
        for _ in range(300):
            t += rng.choice([0, 1, 60, 299, 300, 301, 3600, 3601, 3602, 20_000, 400_000])
            rows.append((srv, t, rng.choice([-0.95, -0.75, -0.55, -0.35])))
    df = frame(spark, rows)
    for thr, sup in ((300, 3600), (3600, 300), (0, 0), (1, 1), (50_000, 10)):
        x = A.episodes(A.alerting(df), max(thr, sup) * 1_000_000).toPandas().sort_values(["server_id", "_t", "window_id"])
        for _, own in x.groupby("server_id", dropna=False):
            new = own["_t"].diff().fillna(1e18) > max(thr, sup) * 1_000_000
            assert (own["episode"] == own["_t"].where(new).ffill()).all()
        got = {r["window_id"]: r["decision"] for r in A.generate_alerts(df, thr, sup, keep_dropped=True).collect()}
        want = {}
        for srv in ("a", "b", None):
            mine = [(i, t, sc) for i, (s, t, sc) in enumerate(rows) if s == srv]
            want.update(zip([i for i, _, _ in mine], A.run_machine(np.array([t * 1_000_000 for _, t, _ in mine]), np.array([str(sc) for _, _, sc in mine]), thr * 1_000_000, sup * 1_000_000)))
        assert got == want
        assert x["episode"].nunique() > 5 or thr == 50_000


def test_fixture_counts(spark):
    out = A.generate_alerts(scores(spark, SF_MID), 43200, 172800, keep_dropped=True)
    counts = {r["decision"]: r["count"] for r in out.groupBy("decision").count().collect()}
    assert counts == {"emitted": 180, "suppressed": 97, "dropped": 74}
    default = A.generate_alerts(scores(spark, SF_MID), 300, 3600, keep_dropped=True)
    assert {r["decision"] for r in default.collect()} == {"emitted"} and default.count() == 351


def test_alert_stats(spark):
    rows = [("s", 0, -0.95), ("s", 100000, -0.75)]
    alerts = A.generate_alerts(frame(spark, rows), 0, 0)
    stats = {r["level"]: (r["alerts"], r["recent_24h"]) for r in
             A.alert_stats(alerts, T0 + dt.timedelta(seconds=100000)).collect()}
    assert stats == {None: (2, 1), "CRITICAL": (1, 0), "HIGH": (1, 1)}
