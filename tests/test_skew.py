"""One key holding a third of all rows: results stay whole and equal a brute-force answer,
and the plans pre-aggregate instead of sorting the hot group."""

import pandas as pd
from pyspark.sql import functions as F

from logsift.operators import alerts as A
from logsift.operators import sanitize as D
from logsift.operators import templates as TM
from logsift.plans.registry import lines, scores

from conftest import SF_MID


def skewed_lines(spark):
    x = lines(spark, SF_MID)
    hot = x.filter(F.col("server_id") == "server-0").withColumn("line_no", F.col("line_no") + 1_000_000)
    hot2 = hot.withColumn("line_no", F.col("line_no") + 1_000_000)
    return x.unionByName(hot).unionByName(hot2)  # server-0 and its lines repeated: a third of all rows


def test_dedupe_first_under_skew(spark):
    x = skewed_lines(spark).select("line_no", "raw_log", F.col("server_id").alias("event_id"))
    got = {(r["raw_log"], r["event_id"]): r["line_no"] for r in D.dedupe_first(x).collect()}
    pdf = x.toPandas()
    want = pdf.sort_values("line_no").groupby(["raw_log", "event_id"])["line_no"].first().to_dict()
    assert got == want
    plan = D.dedupe_first(x)._jdf.queryExecution().executedPlan().toString()
    # a partial aggregate before the exchange, no window sort of the hot group
    assert "partial_min_by" in plan and "+- Window " not in plan


def test_signatures_under_skew(spark):
    x = skewed_lines(spark)
    got = {r["signature"]: r["support"] for r in TM.signatures(x).collect()}
    sig = TM.with_signature(x).groupBy("signature").count().toPandas()
    assert got == dict(zip(sig["signature"], sig["count"]))
    assert sum(got.values()) == x.count()


def test_alerts_of_a_hot_server(spark):
    s = scores(spark, SF_MID)
    hot = s.filter(F.col("server_id") == "server-0")
    shifted = [hot.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {30 * k} DAYS"))
                  .withColumn("window_id", F.col("window_id") + 120 * k) for k in range(1, 5)]
    big = s
    for h in shifted:
        big = big.unionByName(h)
    out = A.generate_alerts(big, 43200, 172800, keep_dropped=True).toPandas()
    assert len(out) == big.filter(F.col("score") <= -0.3).count()
    # the hot server's decisions equal the unsplit machine over its whole series
    import numpy as np
    mine = big.filter((F.col("server_id") == "server-0") & (F.col("score") <= -0.3)).orderBy("ts").toPandas()
    lvl = np.where(mine["score"] <= -0.9, "CRITICAL", np.where(mine["score"] <= -0.7, "HIGH",
                   np.where(mine["score"] <= -0.5, "MEDIUM", "LOW")))
    t = (pd.to_datetime(mine["ts"]).astype("int64") // 1000).to_numpy()
    want = A.run_machine(t, np.char.add("server-0|", lvl.astype(str)), 43200 * 10**6, 172800 * 10**6)
    got = out[out["server_id"] == "server-0"].sort_values("ts")["decision"].tolist()
    assert got == want
