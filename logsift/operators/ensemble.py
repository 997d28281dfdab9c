"""Autoencoder score arithmetic, ensemble and breakdown (O-M5 … O-M8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.scores import ensemble_score, prediction
from ..session import materialize
from .quantile import exact_percentile


def ae_threshold(train_mse: DataFrame, q: float = DEFAULT.ae_percentile) -> float:
    """Percentile (linear) of the training reconstruction errors, computed once for all of its passes."""
    return exact_percentile(materialize(train_mse.select("mse"), "mse"), "mse", q)


def ae_scores_from_mse(df: DataFrame, threshold: float | None = None, q: float = DEFAULT.ae_percentile) -> DataFrame:
    """O-M5: score = -mse / threshold (-mse when threshold <= 0); prediction -1 when mse > threshold."""
    thr = ae_threshold(df.select("mse"), q) if threshold is None else threshold
    t = F.lit(float(thr))
    # 0 - x (not -x) so that a zero error scores +0.0
    return (df.withColumn("ae_score", F.when(t > 0, F.lit(0.0) - F.col("mse") / t).otherwise(F.lit(0.0) - F.col("mse")))
              .withColumn("ae_prediction", F.when(F.col("mse") > t, F.lit(-1)).otherwise(F.lit(1)))
              .withColumn("ae_threshold", t))


def ensemble(df: DataFrame, with_ae: bool = True, w_if: float = DEFAULT.weight_forest,
             w_ae: float = DEFAULT.weight_ae) -> DataFrame:
    """O-M7 (O-M6 when ``with_ae`` is False: AE prediction 1, score 0, weight 0)."""
    if not with_ae:
        df = df.withColumn("ae_prediction", F.lit(1)).withColumn("ae_score", F.lit(0.0))
        w_ae = 0.0
    s = ensemble_score("if_score", "ae_score" if with_ae else None, w_if, w_ae)
    return (df.withColumn("w_if", F.lit(w_if)).withColumn("w_ae", F.lit(w_ae))
              .withColumn("score", s).withColumn("prediction", prediction("score")))


def breakdown(df: DataFrame) -> DataFrame:
    """O-M8: one row per model and window: prediction, score, weight and Normal/Anomaly."""
    keys = [c for c in ("server_id", "window_id") if c in df.columns]
    parts = F.array(
        F.struct(F.lit("isolation_forest").alias("model"), prediction("if_score").alias("model_prediction"),
                 F.col("if_score").alias("model_score"), F.col("w_if").alias("weight")),
        F.struct(F.lit("autoencoder").alias("model"), F.col("ae_prediction").alias("model_prediction"),
                 F.col("ae_score").alias("model_score"), F.col("w_ae").alias("weight")),
        F.struct(F.lit("ensemble").alias("model"), F.col("prediction").alias("model_prediction"),
                 F.col("score").alias("model_score"), F.lit(1.0).alias("weight")),
    )
    x = df.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.*")
    return x.withColumn("label", F.when(F.col("model_prediction") == -1, "Anomaly").otherwise("Normal"))
