"""A corpus pipeline: quality, repeated lines, near duplicates, benchmark passages, token ids.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm import linededup, pieces, quality, simhash, tiling
from logsift.llm.common import read
from logsift.llm.queries import piece_model
from logsift.session import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the threshold or above; the others go."""
    return quality.good_only(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that ten or more documents have; ``n_chars`` is counted again."""
    kept = linededup.dedup_lines(docs)
    new = {"doc_id": F.col("id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set linked at two or fewer differing bits: the one with the smallest id."""
    return simhash.one_of_each(docs, shingle=3, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return tiling.clean(docs, read(spark, sf_dir, "benchmark"))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document that is left, with digests of the ids and of what they decode to."""
    return pieces.round_trip(docs, piece_model(), with_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("piece_ids", piece_ids),
]

#: A learnt score, a graph's components and an agenda of merges are not SQL's: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's result is written to the shared checkpoint folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
