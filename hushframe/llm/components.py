"""Connected components of a table of links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.shared import cut, cut_small, drop, spread_join


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of longs, (node, root) for every linked node but roots; a root is its component's smallest node.

    Alternating large-star and small-star steps: each replaces links by links to
    the smallest known neighbour, by aggregation (combined before the shuffle) and
    joins in which nodes with very many links are spread.  The number of
    steps grows with the logarithm of the number of nodes.  Each step's table is
    written to the shared folder.  Null ends and links to oneself are ignored.
    """
    pairs = cut_small(links.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    rows, mark = pairs.count(), None
    while True:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(pairs.select(F.col("lo"), F.col("hi")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least", 2 * rows)
        wide = spread_join(both, least, "u", "n", total=2 * rows).where("v > u and v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = wide.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = wide.join(low, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = cut(moved.union(low.select("hi", F.col("m").alias("lo"))).distinct(), "stars", rows)
        drop(pairs, least)
        pairs = new
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == mark:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        mark = now
