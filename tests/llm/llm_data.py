import random

import pytest
from pyspark.sql import types as T

SF_SMALL, SF_MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

#: Columns of documents, and further ones whose names the operators use inside.
ODD = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *(T.StructField(c, T.StringType()) for c in ("id", "row", "score", "text_key", "fp", "state", "keep", "a.b"))])


def odd_rows():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    long = prose(120_000)
    copy = prose(60)
    texts = [(1, None), (2, ""), (None, prose(30)), (None, None), (3, long), (4, long), (5, copy), (6, copy), (6, copy), (6, prose(20)),
             (7, " \t\n\x0b\x0c\r "), (8, "\n\n"), (9, "Ünïcode ▁ 漢字 😀\x00 end"), (10, "one"), (11, "one two"), (12, "x" * 50_000)]
    texts += [(20 + i, f"Shared Line \n{prose(15)}\n  shared line\t") for i in range(12)]
    return [(i, t, "en", "s", len(t or ""), *"abcdefgh") for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def texts(spark):
    """(doc_id, text) of the small table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
