"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A tree has regions, racks in regions and shards in racks, each leaf with a weight; an inner node weighs
the sum of its leaves. A row descends from the root: at each level every child draws -ln(u) / weight,
where u is a hash of (key, child) in (0, 1), and the smallest draw wins. So a child is chosen in
proportion to its weight, a draw depends on nothing but the key, the child and its weight, and a change of
weights moves rows only into or out of the subtrees whose weights changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets per shard for the numbering: a shard is numbered bucket by bucket, never as one window.
SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int, regions: int = 2, racks: int = 3, per_rack: int = 4) -> list[Leaf]:
    """The tree for a number of shards: ``regions`` x ``racks`` x ``per_rack`` leaves are filled in order, and each
    further shard stands in a region of its own. From the full base on, one more shard therefore adds one
    subtree and changes the weight of no other, so it takes rows only into itself."""
    if shards < 1:
        raise ValueError("at least one shard")
    base = regions * racks * per_rack
    return [Leaf(s // (racks * per_rack), s // per_rack % racks, s) if s < base else Leaf(regions + s - base, 0, s) for s in range(shards)]


def unit_hash(key: Column, node: str) -> Column:
    """A number in (0, 1) from 48 bits of md5(key / node)."""
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{node}"))), 1, 12), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(float(1 << 48))


def _draw(key: Column, children: list[tuple[int, str, float]]) -> Column:
    """Of (number, node name, weight), the number with the smallest draw; a tie goes to the smaller number."""
    if len(children) == 1:
        return F.lit(children[0][0])
    return F.least(*[F.struct((-F.log(unit_hash(key, node)) / F.lit(w)).alias("draw"), F.lit(i).alias("child")) for i, node, w in children])["child"]


def _choose(at: Column, options: dict[int, Column]) -> Column:
    """The option whose number stands in ``at``; the last one needs no test."""
    *most, (_, last) = options.items()
    out = None
    for i, c in most:
        out = F.when(at == i, c) if out is None else out.when(at == i, c)
    return last if out is None else out.otherwise(last)


def descend(df: DataFrame, key: Column, leaves: list[Leaf], out: str) -> DataFrame:
    """Adds ``out``, the shard that ``key`` (text) descends to: level by level, one choice per column."""
    weight = lambda keep: float(sum(x.weight for x in leaves if keep(x)))
    regions = sorted({x.region for x in leaves})
    racks = {r: sorted({x.rack for x in leaves if x.region == r}) for r in regions}
    at_r, at_k = f"_{out}_region", f"_{out}_rack"
    df = df.withColumn(at_r, _draw(key, [(r, f"region-{r}", weight(lambda x: x.region == r)) for r in regions]))
    df = df.withColumn(at_k, _choose(F.col(at_r), {r: F.lit(1000 * r) + _draw(key, [(k, f"rack-{r}-{k}", weight(lambda x: (x.region, x.rack) == (r, k))) for k in racks[r]]) for r in regions}))
    places = {1000 * r + k: _draw(key, [(x.shard, f"shard-{x.shard}", x.weight) for x in leaves if (x.region, x.rack) == (r, k)]) for r in regions for k in racks[r]}
    return df.withColumn(out, _choose(F.col(at_k), places)).drop(at_r, at_k)


def assign(docs: DataFrame, leaves: list[Leaf], id_col: str = "doc_id", out: str = "shard") -> DataFrame:
    """``docs`` with the column ``out``: the shard of each row's id. A null id is the key "null"; rows with the same
    id go to the same shard; an empty table gives an empty table; other columns stay (one named ``out`` is replaced)."""
    return descend(docs, _key(id_col), leaves, out)


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit("null"))


def number(rows: DataFrame, ids: DataFrame, shard: str, bucket: str, order: list[str], out: str = "slot") -> DataFrame:
    """Gapless numbers from 0 inside each shard. ``ids`` has (shard, bucket) of the same rows: its counts give each bucket's
    first number, so a window holds a bucket of a shard and never a whole shard."""
    ahead = W.partitionBy(shard).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    first = ids.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias("_n")).select(shard, bucket, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first"))
    local = rows.withColumn("_local", F.row_number().over(W.partitionBy(shard, bucket).orderBy(*order)).cast("long") - 1)
    return local.join(first, [shard, bucket]).withColumn(out, F.col("_first") + F.col("_local")).drop("_first", "_local")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document with its place: doc_id, size (UTF-8 bytes of the text plus 8; null text: 8), text_crc32
    (of the UTF-8 text; null: of the empty text), law ``key``, shard, slot (gapless from 0 in its shard), grown_shard
    (the shard if there were one more).

    Null ids share the key "null" and a shard, as rows that repeat an id do; they are numbered in buckets by their text's checksum and size, so one
    id with any number of rows is no window of its own. Repeated rows get one slot each (in any order, as they are equal); texts
    are read twice and never shuffled. Only the columns doc_id and text are read, whatever others there are."""
    key = _key("doc_id")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    spread = F.md5(F.concat_ws("/", key, F.col("text_crc32").cast("string"), F.col("size").cast("string"), F.lit("slot")).cast("binary"))
    rows = descend(rows.withColumn("bucket", F.conv(F.substring(spread, 1, 8), 16, 10).cast("long") % SLOT_BUCKETS), key, layout(shards), "shard")
    out = number(descend(rows, key, layout(shards + 1), "grown_shard"), rows.select("shard", "bucket"), "shard", "bucket", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
