"""End-to-end jobs: ingest (E1), train (O-M9), score (E4), model persistence (O-S9).

Each step is a DataFrame → DataFrame operator; this module only wires them together.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..functions import lines as L
from ..functions.scores import ensemble_score, prediction
from ..operators import autoencoder as AE
from ..operators import features as FE
from ..operators import forest as FO
from ..operators import sanitize as D
from ..operators import templates as TM
from ..operators import windows as W
from ..operators.scaler import fit_scaler
from ..session import materialize, path_kind

KEYS = ["server_id", "window_id"]


def structure_lines(lines: DataFrame, ingest_ts, params: Params = DEFAULT, dedupe: bool = True,
                    templates: DataFrame | None = None, noise: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """E1 as one job graph: strip → ensure time → mask → drop noise → mine/assign templates →
    event time → sanitise → keep first of (raw_log, event_id).

    ``lines`` has ``raw_log`` and ``line_no`` (and usually ``server_id``). Returns the
    structured rows and the templates table (mined here unless ``templates`` is given). ``noise``
    observes how many lines there are and how many of them are dropped as noise.
    """
    x = lines.filter(L.is_nonblank("raw_log"))
    x = L.evaluate_once(x, raw_log=L.clean_line("raw_log", ingest_ts))
    if noise is not None:
        x = x.observe(noise, F.count(F.lit(1)).alias("lines"), F.count_if(L.is_noise("raw_log")).alias("dropped"))
    x = x.filter(~L.is_noise("raw_log"))
    if "server_id" not in x.columns:
        x = x.withColumn("server_id", F.lit("local"))
    if templates is None:
        a, templates = TM.mine_and_assign(x, params.similarity)
    else:
        a = TM.assign_templates(x, templates)
    a = a.withColumn("ts", L.event_time("raw_log", ingest_ts)).drop("signature")
    s = D.sanitize(a, ingest_ts)
    if dedupe:
        s = D.dedupe_first(s, keys=("raw_log", "event_id"), order=("line_no",))
    return s, templates


def window_counts(structured: DataFrame, params: Params = DEFAULT, seconds: int | None = None,
                  origin=None) -> DataFrame:
    """60 s windows from the data's minimum (O-W1) and counts per (server, window, event) (O-F1)."""
    w = W.time_windows(structured, seconds or params.window_seconds, origin=origin)
    return FE.feature_counts(w)


@dataclass
class Model:
    columns: DataFrame               # (event_id, idx, mean, scale): a table, one row per feature
    base: np.ndarray                 # what each column is without a count: -mean / scale
    forest_nodes: pd.DataFrame
    psi: int
    offset: float
    ae: dict | None = None           # dims, weights, threshold
    w_if: float = DEFAULT.weight_forest
    w_ae: float = DEFAULT.weight_ae
    info: dict = field(default_factory=dict)


def model_columns(counts: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """O-F2 + O-M1: the table of columns, written once, and the base vector (as wide as the model)."""
    columns = materialize(FE.feature_table(counts).join(fit_scaler(counts), "event_id"), "columns")
    base = np.zeros(columns.count())
    for r in columns.select("idx", "mean", "scale").toLocalIterator():
        base[r.idx] = -r.mean / r.scale
    return columns, base


def model_vectors(counts: DataFrame, model: Model) -> DataFrame:
    """O-F3 + O-M1: per window its scaled (idx, value) pairs over the model's base."""
    return FE.sparse_vectors(counts, model.columns, KEYS)


#: Windows in a file of vectors that models are trained on.
FILE_WINDOWS = 1 << 13


def training_vectors(counts: DataFrame, columns: DataFrame) -> tuple[DataFrame, int]:
    """O-F3 + O-M1 written once, and how many windows there are. Vectors are a few bytes each but take long to train on, so
    they are dealt out by number: by size, all that a month of minutes has would be one task of every training step."""
    n = counts.select(*KEYS).distinct().count()
    vec = FE.sparse_vectors(counts, columns, KEYS)
    return materialize(vec.repartition(max(1, -(-n // FILE_WINDOWS)), *KEYS), "vectors"), n


def train_models(counts: DataFrame, params: Params = DEFAULT, with_ae: bool = True) -> Model:
    """O-M9: columns, scaler, forest (+ offset) and autoencoder (+ threshold)."""
    columns, base = model_columns(counts)
    if not len(base):
        raise ValueError("no features to train on")
    model = Model(columns=columns, base=base, forest_nodes=pd.DataFrame(), psi=0, offset=0.0)
    vec, n = training_vectors(counts, columns)
    nodes, meta = FO.fit_forest(vec, KEYS, params.n_trees, params.max_samples, params.seed, n=n, base=base)
    model.forest_nodes, model.psi = nodes, meta["psi"]
    raw = FO.score_forest(vec, nodes, model.psi, base=base)
    model.offset = FO.forest_offset(raw, params.contamination)
    if with_ae:
        ae = AE.fit_autoencoder(vec, KEYS, params.epochs, params.batch_size, params.learning_rate,
                                params.validation_split, params.seed, base)
        mse = AE.mse_table(vec, ae, base)
        from ..operators.ensemble import ae_threshold
        thr = ae_threshold(mse.select("mse"), params.ae_percentile)
        model.ae = {"dims": ae["dims"], "weights": ae["weights"], "threshold": thr}
        model.info.update(train_loss=ae["train_loss"], val_loss=ae["val_loss"])
    else:
        model.w_ae = 0.0
    model.info.update(n_windows=n, n_features=len(base))
    return model


def score_windows(counts: DataFrame, model: Model) -> DataFrame:
    """Forest, autoencoder and ensemble scores for every window of ``counts`` (E4)."""
    vec = model_vectors(counts, model)
    x = FO.score_forest(vec, model.forest_nodes, model.psi, model.offset, model.base)
    if model.ae is not None:
        x = AE.mse_table(x, model.ae, model.base)
        thr = F.lit(float(model.ae["threshold"]))
        x = (x.withColumn("ae_score", F.when(thr > 0, F.lit(0.0) - F.col("mse") / thr).otherwise(F.lit(0.0) - F.col("mse")))
              .withColumn("ae_prediction", F.when(F.col("mse") > thr, -1).otherwise(1)))
        s = ensemble_score("if_score", "ae_score", model.w_if, model.w_ae)
    else:
        x = x.withColumn("ae_score", F.lit(0.0)).withColumn("ae_prediction", F.lit(1))
        s = ensemble_score("if_score", None, model.w_if, 0.0)
    return x.drop("pairs").withColumn("score", s).withColumn("prediction", prediction("score"))


# ------------------------------------------------------------------ persistence (O-S9)

def save_model(spark: SparkSession, model: Model, path: str) -> str:
    """Parquet tables (columns, forest nodes, AE weights if any, a row of metadata) in a folder of a new version under ``path``; a row in the
    manifest, written last, makes it the current one. A save that stops before that leaves the version before in force. Returns the version."""
    version = uuid.uuid4().hex
    folder = os.path.join(path, f"version={version}")
    model.columns.write.parquet(os.path.join(folder, "columns"))
    spark.createDataFrame(model.forest_nodes, FO.NODE_SCHEMA).write.parquet(os.path.join(folder, "forest_nodes"))
    meta = {"psi": model.psi, "offset": model.offset,
            "w_if": model.w_if, "w_ae": model.w_ae, "info": model.info,
            "ae_dims": model.ae["dims"] if model.ae else None,
            "ae_threshold": model.ae["threshold"] if model.ae else None}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.parquet(os.path.join(folder, "model_meta"))
    if model.ae is not None:
        w = [float(v) for v in np.asarray(model.ae["weights"])]
        spark.createDataFrame([(w,)], "w array<double>").write.parquet(os.path.join(folder, "ae_weights"))
    number = len(model_versions(spark, path)) + 1
    spark.createDataFrame([(number, version)], MANIFEST).coalesce(1).write.mode("append").parquet(os.path.join(path, "manifest"))
    return version


MANIFEST = "number long, version string"


def model_versions(spark: SparkSession, path: str) -> list[str]:
    """The whole versions saved under ``path``, the current one last."""
    manifest = os.path.join(path, "manifest")
    if path_kind(spark, manifest) is None:
        return []
    return [r.version for r in spark.read.schema(MANIFEST).parquet(manifest).orderBy("number", "version").collect()]


def load_model(spark: SparkSession, path: str, version: str | None = None) -> Model:
    """Reads a saved model: the current version, or a given one; a missing autoencoder table means weight 0 for it (O-M6)."""
    versions = model_versions(spark, path)
    if not versions or version not in (None, *versions):
        raise FileNotFoundError(f"no whole model {version or ''} under {path}")
    path = os.path.join(path, f"version={version or versions[-1]}")
    meta = json.loads(spark.read.parquet(os.path.join(path, "model_meta")).first()["meta"])
    nodes = spark.read.parquet(os.path.join(path, "forest_nodes")).toPandas()
    columns = spark.read.parquet(os.path.join(path, "columns"))
    base = np.zeros(columns.count())
    for r in columns.select("idx", "mean", "scale").toLocalIterator():
        base[r.idx] = -r.mean / r.scale
    model = Model(columns=columns, base=base, forest_nodes=nodes,
                  psi=meta["psi"], offset=meta["offset"], w_if=meta["w_if"], w_ae=meta["w_ae"],
                  info=meta.get("info", {}))
    weights = os.path.join(path, "ae_weights")
    if path_kind(spark, weights) is None:  # no autoencoder saved: it keeps weight 0
        model.ae, model.w_ae = None, 0.0
    else:
        w = spark.read.parquet(weights).first()["w"]
        model.ae = {"dims": meta["ae_dims"], "weights": np.asarray(w), "threshold": meta["ae_threshold"]}
    return model
