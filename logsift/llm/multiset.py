"""Homomorphic multiset fingerprints of documents (DataFrame functions only).

A paragraph (a line that is not empty) is hashed into a wide vector, and a document's fingerprint is the sum of its paragraphs'
vectors, lane by lane modulo 2^32. So the order of paragraphs does not matter, and a paragraph is put in or
taken out by adding or subtracting its vector. Lanes, in order: how many units the paragraph has (up to eight words up to punctuation);
eight words of the paragraph's SHA-256, which tell fingerprints apart; and for each of the 128 bits of an MD5, how many units
have that bit set. From the last ones two fingerprints give a likeness: counts of bits, less half the
units, are sums of random signs, and the cosine of two such vectors is about that of the multisets of units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORDS, BITS = 8, 128
LANES = 1 + WORDS + BITS
UNIT = r"[^ \t\n\x0B\f\r.,;:!?]+(?:[ \t]+[^ \t\n\x0B\f\r.,;:!?]+){0,7}"

#: Rows in order of their id are cut into buckets by quantiles of the id: about one for so many bytes of text, and so many at least
#: and at most. An id that fills several quantiles is cut further, into 64 by the hash of the text.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 32 << 20, 256, 4096

#: A sum of eight bytes side by side holds eight counts of bits, of so many units at most.
_BYTES, _RUN = 0x0101010101010101, 127


def _long(digest: Column, j: int) -> Column:
    """The ``j``-th 64 bits of a digest in hexadecimal digits, as a signed number."""
    return F.conv(F.substring(digest, 1 + 16 * j, 16), 16, -10).cast("long")


def _total(array: Column, of) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + of(x))


def _byte_sums(array: Column) -> Column:
    """For each run of up to 127 numbers the eight sums of their bits i, i + 8, ..., one a byte."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(array) - 1) / F.lit(_RUN))).cast("int")), lambda k: F.slice(array, k * _RUN + 1, _RUN))
    return F.transform(runs, lambda run: F.array(*[_total(run, lambda v, i=i: F.shiftrightunsigned(v, i).bitwiseAND(F.lit(_BYTES))) for i in range(8)]))


def _bit_count(sums: Column, bit: int) -> Column:
    return _total(sums, lambda r: F.shiftrightunsigned(r[bit % 8], bit - bit % 8).bitwiseAND(F.lit(255)))


def with_vector(df: DataFrame, text: Column, out: str) -> DataFrame:
    """``df`` with the fingerprint of ``text`` in the column ``out``, an array of 137 numbers; null and empty texts have
    no paragraphs, and zeros."""
    t, u, p, *rest = names = [f"_{out}_{c}" for c in ("t", "u", "p", "x", "y", "q0", "q1", "q2", "q3")]
    df = df.withColumn(t, F.coalesce(text, F.lit("")))
    df = df.withColumn(p, F.transform(F.filter(F.split(t, "\n"), lambda line: line != ""), lambda line: F.sha2(line.cast("binary"), 256)))
    df = df.withColumn(u, F.transform(F.regexp_extract_all(F.col(t), F.lit(UNIT), F.lit(0)), lambda unit: F.md5(unit.cast("binary"))))
    for name, j in zip(rest[:2], range(2), strict=True):
        df = df.withColumn(name, F.transform(u, lambda d: _long(d, j))).withColumn(name, _byte_sums(F.col(name)))
    for name, j in zip(rest[2:], range(4), strict=True):
        df = df.withColumn(name, F.transform(p, lambda d: _long(d, j)))
    halves = [_total(F.col(q), half) % F.lit(1 << 32) for q in rest[2:] for half in (lambda v: F.shiftrightunsigned(v, 32), lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF)))]
    bits = [_bit_count(F.col(a), b) for a in rest[:2] for b in (*range(32, 64), *range(32))]  # the first of two words is the high half
    return df.withColumn(out, F.array(F.size(u).cast("long"), *halves, *bits)).drop(*names)


def insert(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together."""
    return F.zip_with(a, b, lambda x, y: (x + y) % F.lit(1 << 32))


def remove(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` without the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: (x - y + F.lit(1 << 32)) % F.lit(1 << 32))


def merged(fingerprints: DataFrame, by: list[str], vector: str = "vector") -> DataFrame:
    """Fingerprints of whole groups of documents: the sums of theirs."""
    lanes = [F.sum(F.col(vector)[i]).alias(f"_{i}") for i in range(LANES)]
    return fingerprints.groupBy(*by).agg(*lanes).select(*by, F.array(*[F.col(f"_{i}") % F.lit(1 << 32) for i in range(LANES)]).alias(vector))


def as_text(vector: Column) -> Column:
    """Eight hexadecimal digits a lane."""
    return F.array_join(F.transform(vector, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the cosine of the counts of bits less half the units, and 0 below 0."""
    signs = lambda v: F.transform(F.slice(v, 2 + WORDS, BITS), lambda c: (F.lit(2) * c - F.element_at(v, 1)).cast("double"))
    dot = lambda v, w: F.aggregate(F.zip_with(v, w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    s, t = signs(a), signs(b)
    both = dot(s, s) * dot(t, t)
    return F.when(a == b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(s, t)) / F.sqrt(both)))


def _count_greater(value: Column, cuts: list[int]) -> Column:
    """How many of ``cuts`` (falling) are greater than ``value``: whole blocks of them first, then in one block."""
    if not cuts:
        return F.lit(0)
    g = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + g] for i in range(0, len(cuts), g)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array().cast("array<long>")
    greater = lambda array: F.size(F.filter(array, lambda c: c > value))
    whole = greater(longs([b[-1] for b in blocks]))
    return whole * g + greater(F.element_at(F.array(*[longs(b) for b in [*blocks, []]]), whole + 1))


def _in_buckets(rows: DataFrame, bucket_bytes: int, least: int) -> DataFrame:
    """``rows`` (id, text, ...) with ``bucket``, which follows the order of (id falling, nulls last, hash of the text),
    and ``hash``. Only quantiles of the ids and the size of the texts reach the driver."""
    quantiles = F.percentile_approx("id", [(i + 1) / MOST_BUCKETS for i in range(MOST_BUCKETS - 1)], 10 * MOST_BUCKETS)
    values, size = rows.agg(quantiles, F.sum(F.octet_length("text"))).first()
    buckets = min(MOST_BUCKETS, 1 << (max(least, (size or 0) // bucket_bytes) - 1).bit_length())
    step = MOST_BUCKETS // buckets
    picked = (values or [])[step - 1 :: step]
    cuts = sorted(set(picked), reverse=True)
    often = {x for x, y in zip(picked, picked[1:], strict=False) if x == y}
    is_often = F.col("id").isin(*often) if often else F.lit(False)
    rows = rows.withColumn("hash", F.xxhash64("text"))
    part = F.shiftright("hash", 58) + F.lit(32)
    place = F.when(F.col("id").isNull(), F.lit(2 * len(cuts) + 2)).otherwise(2 * _count_greater(F.col("id"), cuts) + is_often.cast("int"))
    return rows.withColumn("bucket", place.cast("long") * 64 + F.when(F.col("id").isNull() | is_often, part).otherwise(F.lit(0)))


def with_next(docs: DataFrame, carry: list[str], id_col: str = "doc_id", bucket_bytes: int = BUCKET_BYTES, least: int = LEAST_BUCKETS) -> DataFrame:
    """Each row of ``docs`` (integers ``id_col``, ``text``, ``carry``) with the struct ``next``: the text and ``carry`` of the next
    document by falling id; the first one comes after the last.

    Texts are shuffled once, to the bucket that their id falls into. The first row of a bucket goes to the bucket before as well, as
    a guest behind its last row, so a window over one bucket knows every next row. Null ids come last, and rows that repeat an id in
    the order of their texts' hashes; equal rows in any order."""
    cols = ["text", *carry]
    rows = _in_buckets(docs.select(F.col(id_col).cast("long").alias("id"), *cols), bucket_bytes, least)
    thin = _in_order(rows)
    heads = thin.groupBy("bucket").agg(F.min(F.struct("last", "down", "hash")).alias("head"))
    # at most 64 * (2 * MOST_BUCKETS + 3) rows, and as a rule one for each quantile
    before = F.coalesce(F.lag("bucket").over(W.orderBy("bucket")), F.max("bucket").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = heads.select("bucket", before.alias("before"), "head")
    joined = rows.withColumns(_order_columns()).join(F.broadcast(heads), "bucket")
    is_head = F.struct("last", "down", "hash") == F.col("head")
    place = lambda b, guest: F.struct(F.col(b).alias("at"), F.lit(guest).alias("guest"))
    places = F.when(is_head, F.array(place("bucket", 0), place("before", 1))).otherwise(F.array(place("bucket", 0)))
    dealt = joined.select("id", "last", "down", "hash", *cols, F.explode(places).alias("place"))
    order = W.partitionBy("place.at").orderBy("place.guest", "last", "down", "hash")
    out = dealt.withColumn("next", F.lead(F.struct(*cols)).over(order)).filter("place.guest = 0")
    return out.select(F.col("id").alias(id_col), *cols, "next")


def _order_columns() -> dict[str, Column]:
    """Columns that rise in the order of falling ids."""
    return {"last": F.col("id").isNull(), "down": F.bitwise_not("id")}


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.withColumns(_order_columns()).select("bucket", "last", "down", "hash")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, vector) of every row of ``docs``; a null text is an empty one; other columns are not read."""
    return with_vector(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text")), F.col("_text"), "vector").drop("_text")


def compare_edits(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, least: int = LEAST_BUCKETS) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of its code points (rounded down) replaced by as many, or all, of the next document's first. Null
    texts are empty; empty texts have fingerprints of zeros, which are like each other only; an only document is its own next one;
    repeated rows stay; very long texts are arrays of their own row only; extra columns are not read."""
    rows = with_vector(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.col("text"), "vector")
    rows = with_next(rows, ["vector"], bucket_bytes=bucket_bytes, least=least)
    n = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.expr("left(next.text, cast(length(text) div 2 as int))"))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "vector", F.col("next.vector").alias("next"))
    rows = with_vector(rows, F.col("edited"), "edited_vector")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("vector")).alias("fingerprint"),
        as_text(F.col("edited_vector")).alias("edited_fingerprint"), likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"), likeness(F.col("vector"), F.col("next")).alias("near_next"))
