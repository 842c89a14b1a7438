"""Hierarchical weighted hash tree: every row descends region, rack and shard.

At each level a row draws, for each child of the node it is at, -ln(u) / weight with
u from a hash of the row's key and the child's name, and goes to the child of the
least draw.  A node's weight is the sum of its shards'.  A changed weight changes the
draws of that node and of the nodes above it only, so rows move only into subtrees
whose weight rises or out of those whose weight falls.

``layout`` fills racks and regions in order.  A shard that opens a region of its own
takes rows from others only into itself, which is the case for the 25th; a shard added
to a region that already has some also redraws the rows which that region gains.

Everything is DataFrame functions.  Slots number the rows of a shard from 0 without
gaps: rows are dealt to ``SLOT_BUCKETS`` buckets a shard by a hash of their place in the
input, counted per bucket, and numbered within buckets, so that neither a shard nor a
key's rows meet in one task.

Defined results: the text of a null is empty (size 8, crc 0); rows with equal keys are
in one shard, a null key is a key; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hushframe.llm.shared import cut

SHARDS = 24
RACK_SHARDS = 4
REGION_RACKS = 2
SLOT_BUCKETS = 512


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    number: int
    weight: float = 1.0


def layout(n: int, weights: dict[int, float] | None = None) -> tuple[Shard, ...]:
    """n shards: racks of RACK_SHARDS, regions of REGION_RACKS racks, filled in order; weights by shard, else 1."""
    return tuple(Shard(i // (RACK_SHARDS * REGION_RACKS), i // RACK_SHARDS, i, (weights or {}).get(i, 1.0)) for i in range(n))


def draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from 53 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11)
    return -F.ln((bits.cast("double") + 0.5) / F.lit(2.0**53)) / F.lit(float(weight))


def chosen(key: Column, children: dict[int, float], level: str) -> Column:
    """The child with the least draw; of equal draws the smallest number."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    return F.array_min(F.array(*(F.struct(draw(key, f"{level}/{c}", w), F.lit(c).alias("c")) for c, w in sorted(children.items()))))["c"]


def descend(key: Column, tree: tuple[Shard, ...]) -> Column:
    """The shard (int) of a key; shards of weight 0 get nothing."""
    live = [s for s in tree if s.weight > 0]
    sums = lambda part, by: {k: sum(s.weight for s in part if getattr(s, by) == k) for k in sorted({getattr(s, by) for s in part})}

    def below(part: list[Shard], levels: list[str]) -> Column:
        by = levels[0]
        children = sums(part, by)
        if len(levels) == 1:
            return chosen(key, children, by)
        picked, out = chosen(key, children, by), None
        for child in children:
            inner = below([s for s in part if getattr(s, by) == child], levels[1:])
            out = F.when(picked == child, inner) if out is None else out.when(picked == child, inner)
        return out

    return below(live, ["region", "rack", "number"]).cast("int")


def sharded(docs: DataFrame, tree: tuple[Shard, ...], *, key: str = "doc_id", text: str = "text", grown: tuple[Shard, ...] | None = None) -> DataFrame:
    """The key, size, text_crc32, shard, slot, grown_shard (by the grown tree, else null); one row for each row."""
    body, own = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{key}`")
    rows = docs.select(own, (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), descend(own, tree).alias("shard"), (descend(own, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"), F.monotonically_increasing_id().alias("hushframe_at"))
    # Written once: the count and the numbering below must see the same buckets.
    rows = cut(rows, "sharded").withColumn("hushframe_bucket", F.pmod(F.xxhash64("hushframe_at"), F.lit(SLOT_BUCKETS)))
    before = W.partitionBy("shard").orderBy("hushframe_bucket").rowsBetween(W.unboundedPreceding, -1)
    # At most shards * SLOT_BUCKETS rows.
    counts = rows.groupBy("shard", "hushframe_bucket").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "hushframe_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("hushframe_offset"))
    place = F.row_number().over(W.partitionBy("shard", "hushframe_bucket").orderBy("hushframe_at")) - 1
    numbered = rows.withColumn("hushframe_place", place).join(F.broadcast(offsets), ["shard", "hushframe_bucket"])
    return numbered.select(own, "size", "text_crc32", "shard", (F.col("hushframe_offset") + F.col("hushframe_place")).alias("slot"), "grown_shard")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = sharded(docs, layout(SHARDS), grown=layout(SHARDS + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
