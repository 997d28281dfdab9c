"""Leader clustering of shapes (O-T2) as joins over an inverted index.

In a bucket (token count, first token) shapes stand in one order: support falling, then a hash of the text. A shape is a leader
unless a leader before it is like it, which means that at least ``similarity`` of their positions hold the same token and not ``<*>``;
any other shape follows that of the leaders before it that it is most like (the earlier one of equals).

``leaders`` finds them without comparing all shapes. A shape's features are its (position, token) pairs in order of how rare they are
in the bucket. Two shapes with ``need`` features in common share ``parts`` of them among the first ``size - need + parts`` of
either, so only shapes that meet under a key of so many prefix features are compared. A round takes the shapes that are
still open: one with a similar head (the first shape under one of its keys, a partial aggregate, so a group of any
size costs one comparison a shape) waits; the others look through their keys, and those with nothing similar before them are leaders;
they and what is like them leave. Joins are sort-merge joins: what a round writes is small in its files, as keys and tokens repeat,
and many times larger in the memory of a broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

PARAM = "<*>"
#: Keys hold two prefix features where prefixes of that kind have no more than this many, else one.
PAIR_PREFIX = 12

BUCKET = ["n_tokens", "first_token"]


def order_columns() -> list[Column]:
    """The order of a bucket's shapes; ``hash`` keeps equal supports from standing in the order of their texts."""
    return [(-F.col("support")).alias("down"), F.xxhash64("signature").alias("hash"), F.col("signature")]


def need(n: int, similarity: float) -> int:
    """The fewest equal positions of ``n`` whose share is at least ``similarity``."""
    return next((k for k in range(n + 1) if k / n >= similarity), n + 1)


def _needed(similarity: float) -> Column:
    n = F.col("n_tokens").cast("int")
    return F.coalesce(F.get(F.filter(F.sequence(F.lit(0), n), lambda k: k.cast("double") / n >= F.lit(float(similarity))), 0), n + 1)


def _equal(a: Column, b: Column) -> Column:
    """How many positions of two token arrays hold the same token that is no parameter."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != F.lit(PARAM))), lambda same: same))


def _keyed(shapes: DataFrame, similarity: float) -> DataFrame:
    """(key, needed, shape) rows: every key of every shape; shape is the struct (down, hash, signature)."""
    x = shapes.select(*BUCKET, F.struct(*order_columns()).alias("shape"), _needed(similarity).alias("needed"))
    tokens = x.select(*BUCKET, "needed", "shape", F.posexplode(F.split("shape.signature", " ")).alias("at", "token")).filter(F.col("token") != PARAM)
    feature = F.xxhash64(*BUCKET, "at", "token")
    often = tokens.groupBy(feature.alias("feature")).agg(F.count(F.lit(1)).alias("often"))
    rare = tokens.withColumn("feature", feature).join(often, "feature").groupBy("shape", "n_tokens", "needed").agg(F.array_sort(F.collect_list(F.struct("often", "feature"))).alias("f"))
    n = F.col("n_tokens").cast("int")
    pairs = (F.col("needed") >= 2) & (n - F.col("needed") + 2 <= F.lit(PAIR_PREFIX))
    ids = F.transform("f", lambda f: f["feature"])
    rare = rare.filter(F.size("f") >= F.col("needed")).withColumn("pairs", pairs)
    prefix = F.slice(ids, 1, F.greatest(F.lit(0), F.size("f") - F.col("needed") + F.when(F.col("pairs"), F.lit(2)).otherwise(F.lit(1))))
    rare = rare.withColumn("prefix", F.array_sort(prefix))
    two = F.flatten(F.transform("prefix", lambda a: F.transform(F.filter("prefix", lambda b: b > a), lambda b: F.xxhash64(a, b))))
    keys = F.when(F.col("pairs"), two).otherwise(F.col("prefix"))
    return rare.select(F.explode(F.array_distinct(keys)).alias("key"), "needed", "shape")


def _alike(a: str, b: str) -> Column:
    return _equal(F.split(f"{a}.signature", " "), F.split(f"{b}.signature", " ")) >= F.col("needed")


def leaders(shapes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(key, needed, shape) of all shapes and (shape) of the leaders. Every round writes what is still open to the shared folder;
    only its row count reaches the driver."""
    keyed = materialize(_keyed(shapes, similarity), "leader-keys")
    # a shape without enough features is like no other
    found = [shapes.select(F.struct(*order_columns()).alias("shape")).join(keyed.select("shape").distinct().hint("merge"), "shape", "left_anti")]
    left = keyed
    while left.limit(1).count():
        heads = left.groupBy("key").agg(F.min("shape").alias("head"))
        waits = left.join(heads.hint("merge"), "key").filter((F.col("head") < F.col("shape")) & _alike("head", "shape")).select("shape").distinct()
        seek = materialize(left.join(waits.hint("merge"), "shape", "left_anti"), "leader-seek")
        before = left.select("key", F.col("shape").alias("other"))
        led = seek.join(before.hint("merge"), "key").filter((F.col("other") < F.col("shape")) & _alike("other", "shape")).select("shape").distinct()
        new = materialize(seek.join(led.hint("merge"), "shape", "left_anti"), "leader-new")
        found.append(new.select("shape").distinct())
        gone = left.join(new.select("key", F.col("shape").alias("leader")).hint("merge"), "key").filter((F.col("leader") == F.col("shape")) | _alike("leader", "shape")).select("shape").distinct()
        left = materialize(left.join(gone.hint("merge"), "shape", "left_anti"), "leader-left")
    return keyed, reduce(DataFrame.unionByName, found)


def clusters(shapes: DataFrame, similarity: float) -> DataFrame:
    """(signature, event_template) of every shape of ``shapes`` (n_tokens, first_token, signature, support)."""
    keyed, found = leaders(shapes, similarity)
    found = materialize(found, "leaders")
    own = keyed.join(found.hint("merge"), "shape", "left_semi").select("key", F.col("shape").alias("leader"))
    like = keyed.join(own.hint("merge"), "key").filter(F.col("leader") < F.col("shape")).withColumn("equal", _equal(F.split("leader.signature", " "), F.split("shape.signature", " "))).filter(F.col("equal") >= F.col("needed"))
    best = like.groupBy("shape").agg(F.min(F.struct((-F.col("equal")).alias("unlike"), "leader")).alias("best"))
    # a leader has none like it before it
    follows = best.select("shape.signature", F.col("best.leader.signature").alias("leader"))
    members = follows.unionByName(found.select("shape.signature", F.col("shape.signature").alias("leader")))
    at = members.select("leader", F.posexplode(F.split("signature", " ")).alias("at", "token"))
    agreed = at.groupBy("leader", "at").agg(F.min("token").alias("low"), F.max("token").alias("high"))
    agreed = agreed.withColumn("token", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.lit(PARAM)))
    texts = agreed.groupBy("leader").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda t: t["token"]), " ").alias("event_template"))
    return members.join(texts.hint("merge"), "leader").select("signature", "event_template")
