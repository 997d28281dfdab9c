"""SimHash near-dedup by anchor-point covering.

Fingerprints are 64 bits. The anchors are the words of a covering code: the product of two binary Golay codes
(23 bits each, every point within 3 of exactly one code word) over bits 0-22 and 23-45. Two fingerprints that
differ in at most t bits, d1 of them in the first block and d2 in the second, are both near the anchor of either:
the other one lies within 3 + d1 and 3 + d2 of it. So each fingerprint is replicated to every anchor within the
covering radius plus the threshold (61 of 16.8 million on average at t = 2), and compared per anchor with the
fingerprints whose own anchor it is. Copies share a fingerprint and take part once.

Comparing emits no pairs: per anchor the links are folded into a spanning forest at once. Where more than ``MANY`` fingerprints live
at one anchor (a passage with thousands of slightly different copies), links are not found by comparing all of them but by
looking up what each becomes with up to t bits flipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import arrow, utf8_bodies, words
from .graph import components

#: The Golay code's length, covering radius and generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
BITS, RADIUS, GENERATOR = 23, 3, 0b110001110101

SHINGLE, MAX_BITS, SEED = 3, 2, 42
_CHUNK = 1 << 15
#: Homes of an anchor from which on its links are looked up instead of compared, and candidates looked up at a time.
MANY, LOOKED_UP = 2048, 1 << 21


def fingerprint(body: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text: bit i is set if over half of its shingles' XXH64 (seed 42) have it set."""
    w = words(body)
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate(map(len, w), lambda at, n: at + 1 + n))
        starts = [0, *(e + 1 for e in ends)]
        hashes = [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=False)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        h = np.array(hashes[k : k + _CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(h, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(x, shingle) for x in utf8_bodies(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_key"), pa.array(f)], names=["id", "text_key", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, fp) of every row; null and empty texts have fingerprint 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    return arrow(rows, _fingerprints(shingle), f"id {docs.schema[id_col].dataType.simpleString()}, text_key long, fp long")


def _remainder(x: int) -> int:
    """The syndrome of a 23-bit word: its polynomial modulo the generator."""
    for k in range(BITS - 1, 10, -1):
        if x >> k & 1:
            x ^= GENERATOR << (k - 11)
    return x


def _syndrome(word: Column) -> Column:
    """The syndrome in SQL: each of its 11 bits is the parity of some bits of the word."""
    out = F.lit(0).cast("long")
    for j in range(11):
        mask = sum(1 << k for k in range(BITS) if _remainder(1 << k) >> j & 1)
        out = out.bitwiseOR(F.shiftleft((F.bit_count(word.bitwiseAND(F.lit(mask))) % 2).cast("long"), j))
    return out


def _errors(spark: SparkSession, max_bits: int, block: str) -> DataFrame:
    """(syndrome, error, excess): what to flip in a word to reach each code word within radius plus threshold, and how far
    beyond the radius that is. Its size is fixed by the code: 44,552 rows at 2 bits."""
    rows = [(_remainder(e), e, max(0, n - RADIUS)) for n in range(RADIUS + max_bits + 1) for e in (sum(1 << k for k in at) for at in combinations(range(BITS), n))]
    return spark.createDataFrame(rows, f"s{block} long, e{block} long, x{block} int")


def replicas(points: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(anchor, away, fp): each fingerprint at every anchor that it must be compared at; ``away`` is 0 at its own."""
    spark, mask = points.sparkSession, F.lit((1 << BITS) - 1)
    first = F.col("fp").bitwiseAND(mask)
    second = F.shiftrightunsigned("fp", BITS).bitwiseAND(mask)
    p = points.select("fp", first.alias("w1"), second.alias("w2")).withColumn("s1", _syndrome(F.col("w1"))).withColumn("s2", _syndrome(F.col("w2")))
    p = p.join(F.broadcast(_errors(spark, max_bits, "1")), "s1").join(F.broadcast(_errors(spark, max_bits, "2")), "s2")
    excess = F.col("x1") + F.col("x2")
    anchor = F.col("w1").bitwiseXOR(F.col("e1")).bitwiseOR(F.shiftleft(F.col("w2").bitwiseXOR(F.col("e2")), BITS))
    return p.filter(excess <= max_bits).select(anchor.alias("anchor"), F.least(excess, F.lit(1)).cast("byte").alias("away"), "fp")


def _forest(fp: np.ndarray, starts: np.ndarray, ends: np.ndarray, homes: np.ndarray, max_bits: int) -> np.ndarray:
    """For each row the first row of its linked set inside its anchor. Rows of an anchor are contiguous, the ``homes`` that
    live there first; each home in turn is compared with all rows after it, in all anchors at once."""
    bits = fp.view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
    root = np.arange(len(fp))
    up = np.arange(len(fp))
    live = np.flatnonzero((homes > 0) & (ends - starts > 1))
    j = 0
    while len(live):
        size = ends[live] - starts[live]
        centre = np.repeat(starts[live] + j, size)
        rows = np.arange(size.sum()) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size) + np.repeat(starts[live], size)
        linked = np.bitwise_count(bits[rows] ^ bits[centre]) <= max_bits
        linked &= rows >= centre
        r = root[rows]
        lowest = np.full(len(live), len(fp))
        of = np.repeat(np.arange(len(live)), size)
        np.minimum.at(lowest, of[linked], r[linked])
        up[r[linked]] = lowest[of[linked]]
        root[rows] = up[r]
        j += 1
        live = live[(homes[live] > j) & (ends[live] - starts[live] > j + 1)]
    return root


def _flips(max_bits: int) -> np.ndarray:
    """All 64-bit words with 1 to ``max_bits`` bits."""
    return np.array([sum(1 << k for k in at) for n in range(1, max_bits + 1) for at in combinations(range(64), n)], np.uint64)


def _forest_by_lookup(fp: np.ndarray, max_bits: int) -> np.ndarray:
    """For each row of one anchor the first row of its linked set: every fingerprint with up to ``max_bits`` bits flipped (2,080 of
    them at 2 bits) is looked up among all. The work is in proportion to the rows, however many are close to each other, and
    links are folded in as they are found."""
    bits = fp.view(np.uint64)
    order = np.argsort(bits, kind="stable")
    known, flips = bits[order], _flips(max_bits)
    root = np.arange(len(fp))
    first = np.flatnonzero(np.r_[True, known[1:] != known[:-1]])
    root[order] = np.minimum.reduceat(order, first)[np.cumsum(np.r_[True, known[1:] != known[:-1]]) - 1]  # equal ones
    step = max(1, LOOKED_UP // len(flips))
    for k in range(0, len(known), step):
        wanted = (known[k : k + step, None] ^ flips[None, :]).ravel()
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        hit = np.flatnonzero(known[at] == wanted)
        a, b = order[k + hit // len(flips)], order[at[hit]]
        while True:  # the higher root of each link goes under the lower one, until none differ
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    return root


def _links(max_bits: int) -> Callable:
    """Of rows sorted by (anchor, away, fp): the links of each anchor as (a, b), at most one per row. Holds one batch and the
    anchor that is still open (8 bytes for each different fingerprint there)."""

    def closed(anchor: np.ndarray, away: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(fp) else np.zeros(0, int)
        ends = np.r_[starts[1:], len(fp)] if len(fp) else starts
        homes = np.add.reduceat((away == 0).astype(np.int64), starts) if len(fp) else starts
        many = np.flatnonzero(homes > MANY)
        root = _forest(fp, starts, ends, np.where(homes > MANY, 0, homes), max_bits)
        for k in many.tolist():
            root[starts[k] : ends[k]] = starts[k] + _forest_by_lookup(fp[starts[k] : ends[k]], max_bits)
        at = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[root[at]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for b in batches:
            cols = tuple(b.column(c).to_numpy() for c in ("anchor", "away", "fp"))
            if not len(cols[0]):
                continue
            change = np.flatnonzero(cols[0][1:] != cols[0][:-1])
            same = not parts or parts[-1][0][-1] == cols[0][0]
            cut = change[-1] + 1 if len(change) else 0
            if same and not len(change):
                parts.append(cols)
                continue
            whole = [*parts, tuple(c[:cut] for c in cols)]
            yield closed(*(np.concatenate(x) for x in zip(*whole, strict=True)))
            parts = [tuple(c[cut:] for c in cols)]
        if parts:
            yield closed(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def links(points: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): a spanning set of the links between different fingerprints (column ``fp``, each once) that differ in at most
    ``max_bits`` bits. Every link is a path in it."""
    dealt = replicas(points, max_bits).repartition("anchor").sortWithinPartitions("anchor", "away", "fp")
    return arrow(dealt, _links(max_bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, fp, component, kept_key) of every row of ``docs``: the smallest id of its linked set, and the text_key of
    the row of that set which stays (that with the smallest id, then the smallest text_key).

    Rows without an id link like others; a set's smallest id is that of its rows with one, null only if none has.
    Null, empty and wordless texts have fingerprint 0 and link like any other. Repeated rows share a fingerprint.
    Extra columns are ignored; an empty table gives an empty result."""
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key"))
    points = materialize(prints.groupBy("fp").agg(first.alias("first")), "simhash-points")
    label = components(links(points.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    labelled = points.join(label, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    rep = labelled.groupBy("label").agg(F.min("first").alias("rep"))
    by_fp = labelled.join(rep, "label").select("fp", F.col("rep.id").alias("component"), F.col("rep.text_key").alias("kept_key"))
    return prints.join(by_fp, "fp").select("id", "text_key", "fp", "component", "kept_key")


def hex_fingerprint(fp: Column) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each linked set: that with the smallest doc_id (a repeated row stays once)."""
    dup = near_duplicates(docs, shingle, max_bits)
    kept = dup.filter(F.col("id").eqNullSafe(F.col("component")) & (F.col("text_key") == F.col("kept_key"))).select(F.col("id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    joined = own.join(kept, own["id"].eqNullSafe(kept["_id"]) & (own["key"] == kept["_key"]), "left_semi")
    once = joined.dropDuplicates(["id", "key"]).select("row")
    return once.select(*[F.col("row")[c].alias(c) for c in docs.columns])
