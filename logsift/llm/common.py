"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, as Spark's own splits deliver it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with this package shipped to the workers, as the functions here refer to it."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def remove_table(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that an operator wrote under the checkpoint folder and needs no more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo: the fixed hold-out rule (a null id counts as the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def utf8_bodies(col: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a string column, null as empty, without decoding."""
    for v in col.cast(pa.binary()):
        yield v.as_py() or b""


def words(body: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. ``bytes.lower`` and ``bytes.split`` know ASCII only,
    which is exactly the rule."""
    return body.lower().split()
