"""Isolation forest and autoencoder invariants."""

import dataclasses

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logsift.operators import autoencoder as AE
from logsift.operators import features as FE
from logsift.operators import forest as FO
from logsift.operators.ensemble import ae_threshold
from logsift.operators.quantile import exact_percentile
from logsift.config import Params
from logsift.plans import jobs as J
from logsift.plans import stages as P
from logsift.plans.registry import INGEST, lines

from conftest import SF_SMALL


def blob(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[0] = [12.0, -12.0, 12.0, -12.0]  # planted outlier
    pdf = pd.DataFrame({"k": np.arange(n), "x": list(x)})
    return spark.createDataFrame(pdf, "k long, x array<double>")


def test_forest_ranks_outlier_lowest(spark):
    v = blob(spark)
    nodes, meta = FO.fit_forest(v, ["k"], n_trees=50)
    raw = FO.score_forest(v, nodes, meta["psi"]).persist()
    s = raw.toPandas().set_index("k")["if_raw"]
    assert s.idxmin() == 0
    assert ((s > -1) & (s < 0)).all()
    off = FO.forest_offset(raw, 0.01)
    scored = FO.score_forest(v, nodes, meta["psi"], off)
    share = scored.filter(F.col("if_prediction") == -1).count() / 3000
    assert 0.005 <= share <= 0.02


def test_forest_sampling(spark):
    for n in (100, 256, 600, 3000):  # one rule below and above 2·psi rows
        s = FO.sample_for_trees(blob(spark, n), n, ["k"], n_trees=4, psi=256, seed=42)
        per_tree = {r["tree_id"]: r["count"] for r in s.groupBy("tree_id").count().collect()}
        assert per_tree == {t: min(n, 256) for t in range(4)}


def test_sparse_rows_grow_and_score_the_same_forest(spark):
    v = blob(spark, 500)
    base = np.array([0.5, -1.0, 0.0, 2.0])
    pairs = F.transform("x", lambda x, i: F.struct(i.cast("int").alias("idx"), (x - F.element_at(F.array(*map(F.lit, base.tolist())), i + 1)).alias("v")))
    s = v.select("k", pairs.alias("pairs"))
    a, meta = FO.fit_forest(v, ["k"], n_trees=10)
    b, _ = FO.fit_forest(s, ["k"], n_trees=10, base=base)
    assert (a["feature"] == b["feature"]).all() and np.allclose(a["threshold"], b["threshold"])
    x = FO.score_forest(v, a, meta["psi"]).toPandas().set_index("k")["if_raw"]
    y = FO.score_forest(s, b, meta["psi"], base=base).toPandas().set_index("k")["if_raw"]
    assert np.allclose(x.sort_index(), y.sort_index())


def test_exact_percentile(spark):
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=3001), np.r_[np.zeros(900), np.ones(100)], rng.integers(0, 5, 1000) * 1.0, np.array([3.0]), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
        for q in (0.0, 0.01, 0.5, 0.95, 1.0):
            want = np.quantile(values, q)
            assert np.isclose(exact_percentile(df, "v", q), want, rtol=0, atol=1e-12)
            assert np.isclose(exact_percentile(df, "v", q, bracket=10), want, rtol=0, atol=1e-12)
    assert np.isnan(exact_percentile(df.limit(0), "v", 0.5))


def test_training_does_not_depend_on_partitions(spark):
    v = blob(spark, 1500)
    a = AE.fit_autoencoder(v.repartition(4), ["k"], epochs=5)
    b = AE.fit_autoencoder(v.repartition(40), ["k"], epochs=5)
    assert np.abs(a["weights"] - b["weights"]).max() < 1e-9 and np.allclose(a["train_loss"], b["train_loss"], rtol=1e-12)


def test_a_step_is_the_mean_gradient_of_all_rows(spark):
    """The first steps equal Adam on the whole matrix in one process, for arrays and for pairs over a base."""
    v = blob(spark, 700)
    x = np.stack(v.orderBy("k").toPandas()["x"])
    base = np.array([0.5, -1.0, 0.0, 2.0])
    pairs = F.transform("x", lambda x, i: F.struct(i.cast("int").alias("idx"), (x - F.element_at(F.array(*map(F.lit, base.tolist())), i + 1)).alias("v")))
    a = AE.fit_autoencoder(v, ["k"], epochs=3, validation_split=0.0)
    b = AE.fit_autoencoder(v.select("k", pairs.alias("pairs")), ["k"], epochs=3, validation_split=0.0, base=base)
    dims = AE.layer_dims(4)
    adam = AE.Adam(AE.flatten(AE.init_params(dims, 42)), min(AE.MOST_RATE, 0.001 * (700 / 32) ** 0.5))
    for _ in range(3):
        adam.step(AE.flatten(AE.gradients(AE.unflatten(adam.flat, dims), x)[1]))
    assert np.allclose(a["weights"], adam.flat, atol=1e-9) and np.allclose(b["weights"], adam.flat, atol=1e-9)


def test_many_features_train(spark):
    """A vocabulary far wider than any matrix of it: no cap, and rows stay sparse."""
    n = 12_000
    counts = spark.range(n).select(F.lit("s").alias("server_id"), (F.col("id") % 300).alias("window_id"), F.concat(F.lit("e"), F.col("id")).alias("event_id"), F.lit(2).cast("long").alias("cnt"))
    model = P.train_models(counts, Params(epochs=1, n_trees=10))
    assert model.info["n_features"] == n
    assert P.score_windows(counts, model).filter("score is not null").count() == 300


def test_autoencoder_learns(spark):
    v = blob(spark, 1500)
    m = AE.fit_autoencoder(v, ["k"])
    assert m["train_loss"][-1] < 0.5 * m["train_loss"][0] and m["val_loss"] < 0.6 * m["train_loss"][0]
    mse = AE.mse_table(v, m).toPandas().set_index("k")["mse"]
    assert mse.idxmax() == 0


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    dims = [3, 4, 2, 3]
    params = AE.init_params(dims, 1)
    x = rng.normal(size=(5, 3))
    _, g = AE.gradients(params, x)
    eps = 1e-6
    for i in (0, 3, 5):
        p = params[i]
        idx = (0,) * p.ndim
        old = p[idx]
        p[idx] = old + eps
        up = np.mean((AE.forward(params, x)[-1] - x) ** 2)
        p[idx] = old - eps
        dn = np.mean((AE.forward(params, x)[-1] - x) ** 2)
        p[idx] = old
        assert abs((up - dn) / (2 * eps) - g[i][idx]) < 1e-6


def test_train_save_load_roundtrip(spark, tmp_path):
    s, _ = P.structure_lines(lines(spark, SF_SMALL), INGEST)
    counts = P.window_counts(s).persist()
    params = Params(epochs=3, n_trees=20)
    model = P.train_models(counts, params)
    path = str(tmp_path / "model")
    P.save_model(spark, model, path)
    back = P.load_model(spark, path)
    a = P.score_windows(counts, model).select("server_id", "window_id", "score").toPandas()
    b = P.score_windows(counts, back).select("server_id", "window_id", "score").toPandas()
    m = a.merge(b, on=["server_id", "window_id"])
    assert len(m) == len(a) > 0 and np.allclose(m["score_x"], m["score_y"])
    # without the autoencoder table the model scores with the forest only (weight 0)
    import shutil
    shutil.rmtree(f"{path}/version={P.model_versions(spark, path)[-1]}/ae_weights")
    fo = P.load_model(spark, path)
    assert fo.ae is None and fo.w_ae == 0.0
    assert P.score_windows(counts, fo).count() == len(a)


def test_a_save_that_stops_half_way_is_never_loaded(spark, tmp_path):
    counts = spark.range(200).select(F.lit("s").alias("server_id"), (F.col("id") % 40).alias("window_id"), F.concat(F.lit("e"), F.col("id") % 5).alias("event_id"), (F.col("id") % 7 + 1).alias("cnt"))
    model = P.train_models(counts, Params(epochs=1, n_trees=5))
    path = str(tmp_path / "model")

    def stops():  # behind the columns, the nodes and the metadata
        with pytest.raises(TypeError):
            P.save_model(spark, dataclasses.replace(model, ae={**model.ae, "weights": [object()]}), path)

    stops()
    with pytest.raises(FileNotFoundError):
        P.load_model(spark, path)
    first = P.save_model(spark, model, path)
    model.offset += 1.0
    stops()
    assert P.model_versions(spark, path) == [first] and P.load_model(spark, path).offset == model.offset - 1.0
    second = P.save_model(spark, model, path)
    assert P.load_model(spark, path).offset == model.offset and P.load_model(spark, path, first).offset == model.offset - 1.0
    assert P.model_versions(spark, path) == [first, second]


def test_joins_with_the_node_table_equal_the_array_walk(spark):
    """A grown forest and the closed-form one, walked by joins and by arrays."""
    v = blob(spark, 800)
    nodes, meta = FO.fit_forest(v, ["k"], n_trees=20)
    a = FO.score_forest(v, nodes, meta["psi"]).toPandas().set_index("k")["if_raw"].sort_index()
    b = FO.walk_forest(v, spark.createDataFrame(nodes, FO.NODE_SCHEMA), ["k"], meta["psi"], meta["max_depth"]).toPandas().set_index("k")["if_raw"].sort_index()
    assert len(b) == 800 and np.allclose(a, b, atol=1e-12)
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    forest = J.closed_form_forest(spark)
    a = FO.score_forest(e, forest.toPandas(), 256).toPandas().set_index("vec_id")["if_raw"].sort_index()
    b = FO.walk_forest(e, forest, ["vec_id"], 256, 5).toPandas().set_index("vec_id")["if_raw"].sort_index()
    assert np.allclose(a, b, atol=1e-12) and b.nunique() > 50


def test_columns_are_numbered_in_the_order_of_ids(spark):
    counts = spark.range(5000).select(F.concat(F.lit("e"), F.col("id") % 777).alias("event_id"))
    rows = FE.feature_table(counts).collect()
    want = sorted({f"e{k}" for k in range(777)})
    assert {r.event_id: r.idx for r in rows} == {e: i for i, e in enumerate(want)} and len(rows) == 777
    assert "PythonRDD" not in FE.feature_table(counts)._jdf.queryExecution().toString()


def test_training_is_dealt_over_tasks_by_the_number_of_windows(spark, monkeypatch):
    """A model's vectors are a few bytes each: by size, all of them would be one task of every step."""
    counts = spark.range(400).select(F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("server_id"), (F.col("id") % 100).alias("window_id"),
                                     F.concat(F.lit("e"), (F.col("id") % 7).cast("string")).alias("event_id"), (F.col("id") % 5 + 1).alias("cnt"))
    params = Params(epochs=3, n_trees=5)
    seen = []
    fit = AE.fit_autoencoder
    monkeypatch.setattr(AE, "fit_autoencoder", lambda vec, *a: (seen.append(len(vec.inputFiles())), fit(vec, *a))[1])
    whole = P.train_models(counts, params)
    monkeypatch.setattr(P, "FILE_WINDOWS", 8)
    dealt = P.train_models(counts, params)
    assert seen[0] == 1 and seen[1] > 8
    assert dealt.info["n_windows"] == whole.info["n_windows"] == counts.select("server_id", "window_id").distinct().count()
    pd.testing.assert_frame_equal(*(m.forest_nodes.sort_values(["tree_id", "node_id"], ignore_index=True) for m in (whole, dealt)))
    assert np.allclose(whole.ae["weights"], dealt.ae["weights"]) and np.isclose(whole.offset, dealt.offset) and np.isclose(whole.ae["threshold"], dealt.ae["threshold"])


def test_thresholds_score_each_row_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def told(batches):
        for pdf in batches:
            rows.add(len(pdf))
            yield pdf

    for find, col in ((FO.forest_offset, "if_raw"), (ae_threshold, "mse")):
        before = rows.value
        x = spark.range(1000).select((F.col("id") / 1000.0).alias(col))
        got = find(x.mapInPandas(told, x.schema), 0.25)
        assert np.isclose(got, 0.24975) and rows.value - before == 1000
