"""Golden rows for windows, scaler, ensemble, levels and monitoring operators (FIXTURES.md §4)."""

import datetime as dt
import math

import pytest

from logsift.functions import scores as S
from logsift.operators import features as FE
from logsift.operators import monitoring as M
from logsift.operators import windows as W
from logsift.operators.ensemble import ensemble
from logsift.operators.scaler import fit_scaler

T0 = dt.datetime(2024, 1, 1)


def series(spark, values, server="s1"):
    rows = [(server, i, T0 + dt.timedelta(minutes=i), float(v), -1 if v < 0 else 1) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "server_id string, window_id long, ts timestamp_ntz, score double, prediction int")


def test_time_window_offsets(spark):
    ts = [T0 + dt.timedelta(seconds=s) for s in (0, 59.999, 60, 121)]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz")
    assert [r[0] for r in W.time_windows(df, 60).orderBy("ts").select("window_id").collect()] == [0, 0, 1, 2]


def test_line_windows(spark):
    df = spark.createDataFrame([(0,), (99,), (100,), (250,)], "line_no long")
    assert [r[0] for r in W.line_windows(df, 100).select("window_id").collect()] == [0, 0, 1, 2]


def test_scaler(spark):
    c = spark.createDataFrame([("s", 0, "a", 2), ("s", 0, "b", 5), ("s", 1, "b", 5)],
                              "server_id string, window_id long, event_id string, cnt long")
    sc = {r["event_id"]: (r["mean"], r["scale"]) for r in fit_scaler(c).collect()}
    assert sc["a"] == (1.0, 1.0)  # counts 0 and 2: mean 1, population std 1
    assert sc["b"] == (5.0, 1.0)  # constant: divides by 1, so 7 scales to 2
    assert (7 - sc["b"][0]) / sc["b"][1] == 2


def test_ensemble(spark):
    df = spark.createDataFrame([(0.1, -0.5)], "if_score double, ae_score double")
    with_ae = ensemble(df).first()
    assert round(with_ae["score"], 6) == -0.125046 and with_ae["prediction"] == -1
    assert round(0.6 * math.tanh(0.1) + 0.4 * math.tanh(-0.5), 6) == -0.125046
    without = ensemble(df, with_ae=False).first()
    assert round(without["score"], 6) == 0.059801 and without["prediction"] == 1
    assert without["ae_prediction"] == 1 and without["ae_score"] == 0.0


@pytest.mark.parametrize("score,alert,risk", [
    (-0.9, "CRITICAL", "CRITICAL"), (-0.7, "HIGH", "HIGH"), (-0.5, "MEDIUM", "MEDIUM"),
    (-0.3, "LOW", "LOW"), (-0.29, "NORMAL", "LOW"), (0.5, "NORMAL", "LOW")])
def test_levels(spark, score, alert, risk):
    df = spark.createDataFrame([(score,)], "score double")
    r = df.select(S.alert_level("score"), S.risk_level("score")).first()
    assert (r[0], r[1]) == (alert, risk)


def test_drift(spark):
    base = spark.createDataFrame([("s1", 1.0, 0.0)], "server_id string, p_normal double, p_anomaly double")
    d = M.drift(series(spark, [1, 1, 1, -1]), window=4, baseline=base).collect()
    assert len(d) == 1 and d[0]["drift"] == 0.25 and d[0]["drift_detected"]
    assert M.drift(series(spark, [1, 1, 1]), window=4, baseline=base).count() == 0
    base2 = spark.createDataFrame([("s1", 0.75, 0.25)], "server_id string, p_normal double, p_anomaly double")
    # drift equal to the threshold is not drift (strictly greater); exact binary values
    d2 = M.drift(series(spark, [1, 1, 1, 1]), window=4, threshold=0.25, baseline=base2).first()
    assert d2["drift"] == 0.25 and not d2["drift_detected"]


def test_drift_default_baseline(spark):
    d = M.drift(series(spark, [1, 1, 1, 1, -1, -1]), window=4).orderBy("window_id").collect()
    assert [r["drift"] for r in d] == [0.0, 0.25, 0.5]
    assert [r["drift_detected"] for r in d] == [False, True, True]


def test_risk(spark):
    assert [r["risk_score"] for r in M.risk_columns(series(spark, [0.1, 0.2])).collect()] == [0.0, 0.0]
    r = M.risk_columns(series(spark, [-0.2, -0.2, -0.2])).orderBy("window_id").collect()
    assert r[-1]["risk_score"] == 30.0
    r = M.risk_columns(series(spark, [0.5, 0.5, 0.5])).orderBy("window_id").collect()
    assert r[-1]["risk_score"] == 0.0


def test_trend(spark):
    vals = [0.0] * 5 + [1.0] * 5
    r = M.risk_columns(series(spark, vals)).orderBy("window_id").collect()
    assert r[-1]["trend"] == 1.0 and r[-2]["trend"] == 0.0


def test_health(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (-1.0, 1.0, 1000.0, -2.0)],
                               "s double, e double, v double, t double")
    got = [r[0] for r in df.select(S.health_score("s", "e", "v", "t")).collect()]
    assert got == [75.0, 0.0]


def test_forecast(spark):
    f = M.forecast(series(spark, [1, 2, 3]), n=2).orderBy("step").collect()
    assert [round(r["forecast"], 9) for r in f] == [4.0, 5.0]
    f = M.forecast(series(spark, [7, 9]), n=2).orderBy("step").collect()
    assert [r["forecast"] for r in f] == [9.0, 9.0]


def test_histogram(spark):
    h = M.score_histogram(series(spark, list(range(11))), bins=10).orderBy("bin").collect()
    assert [r["cnt"] for r in h] == [2] + [1] * 9
    same = M.score_histogram(series(spark, [3, 3]), bins=10).orderBy("bin").collect()
    assert same[0]["cnt"] == 2 and sum(r["cnt"] for r in same) == 2


def test_rolling_rate(spark):
    r = M.rolling_anomaly_rate(series(spark, [-1, 1, -1]), 2).orderBy("window_id").collect()
    assert [x["anomaly_rate"] for x in r] == [1.0, 0.5, 0.5]


def test_root_cause(spark):
    c = spark.createDataFrame([("s", 0, e, n) for e, n in (("a", 3), ("b", 0), ("c", 5), ("d", 3))],
                              "server_id string, window_id long, event_id string, cnt long")
    t = spark.createDataFrame([("c", "tmpl C")], "event_id string, event_template string")
    r = M.root_cause(c, t, top_n=2).orderBy("rank").collect()
    assert [(x["cause"], x["cnt"]) for x in r] == [("tmpl C", 5), ("Event_a", 3)]


def test_feature_matrix_and_alignment(spark):
    c = spark.createDataFrame([("s", 0, "b", 2), ("s", 1, "z", 1)],
                              "server_id string, window_id long, event_id string, cnt long")
    wide = FE.feature_matrix(c).orderBy("window_id").collect()
    assert [(r["b"], r["z"]) for r in wide] == [(2, 0), (0, 1)]
    dv = FE.dense_vectors(c, ["a", "b"]).orderBy("window_id").collect()
    assert [r["features"] for r in dv] == [[0.0, 2.0], [0.0, 0.0]]  # unknown z dropped, window kept


def test_latest_window_and_state(spark):
    s = series(spark, [0.1, -0.2, 0.3])
    st = M.server_state(s).first()
    assert st["window_id"] == 2 and st["score"] == 0.3
    k = M.kpis(s).first()
    assert (k["latest_score"], k["anomaly_count"], k["samples"], k["peak_score"]) == (0.3, 1, 3, 0.3)
    h = M.history_tail(s, 2).orderBy("idx").collect()
    assert [(r["idx"], r["score"]) for r in h] == [(0, -0.2), (1, 0.3)]
