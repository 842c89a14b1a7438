"""Thresholds, overlaps and attribution: spans of a row become disjoint clusters.

Overlapping spans (touching ones are apart) become one cluster over their union, so
coverage only grows; the span that ranks highest by confidence, length and
sensitivity decides its kind, the first listed of equal ones.  A cluster whose kind
the policy ignores stays in the text as a whole, whatever else it covers.

All of it is folds over arrays within the row.  The exploded forms (islands_by_window)
do the same by window functions for span tables that are already relational.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hushframe.sources.policies import Policy, sensitivity

CLUSTER_TYPE = "struct<start:int,end:int,text:string,field_type:string,detector:string,confidence:double,reason:string,sources:array<string>>"


def above_threshold(spans: Column, policy: Policy) -> Column:
    """Spans of kinds in the policy, with at least its confidence."""
    return F.filter(spans, lambda s: F.coalesce(s["confidence"] >= policy.threshold(s["field_type"]), F.lit(False)))


def source(detector: Column) -> Column:
    return F.when(detector.isin("fixture", "llm"), detector).otherwise("detector")


def clusters(spans: Column, text: Column) -> Column:
    """array<CLUSTER_TYPE> in text order."""
    ranked = lambda s, i: F.struct(s["confidence"].alias("c"), (s["end"] - s["start"]).alias("n"), sensitivity(s["field_type"]).alias("s"), (-s["start"]).alias("a"), (-s["end"]).alias("b"), (-i).alias("d"), s["field_type"].alias("field_type"), s["detector"].alias("detector"), s["reason"].alias("reason"))
    listed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("seq"), ranked(s, i).alias("best"), F.array(source(s["detector"])).alias("sources")))
    ordered = F.array_sort(F.filter(listed, lambda x: x["start"] < x["end"]))
    best = "struct<c:double,n:int,s:int,a:int,b:int,d:int,field_type:string,detector:string,reason:string>"
    empty = F.array().cast(f"array<struct<start:int,end:int,best:{best},sources:array<string>>>")

    def join(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.greatest(last["best"], x["best"]).alias("best"), F.array_union(last["sources"], x["sources"]).alias("sources"))
        apart = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["best"].alias("best"), x["sources"].alias("sources"))
        return F.when(x["start"] < last["end"], F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(acc, F.array(apart)))

    def cluster(x: Column) -> Column:
        return F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("text"),
            x["best"]["field_type"].alias("field_type"),
            x["best"]["detector"].alias("detector"),
            x["best"]["c"].alias("confidence"),
            x["best"]["reason"].alias("reason"),
            F.array_sort(x["sources"]).alias("sources"),
        )

    return F.transform(F.aggregate(ordered, empty, join), cluster)


def attribution(found: Column) -> Column:
    """Counts over clusters by where they come from; ignored kinds count too."""
    count = lambda test: F.size(F.filter(found, test))
    by_llm = F.filter(found, lambda c: F.array_contains(c["sources"], "llm"))
    return F.struct(
        count(lambda c: source(c["detector"]) == "fixture").alias("removed_by_fixture_canary"),
        count(lambda c: source(c["detector"]) == "detector").alias("removed_by_detector"),
        count(lambda c: source(c["detector"]) == "llm").alias("removed_by_llm"),
        count(lambda c: F.size(c["sources"]) > 1).alias("removed_by_combined"),
        F.size(by_llm).alias("llm_unique_spans_accepted"),
        F.array_sort(F.array_distinct(F.transform(by_llm, lambda c: c["field_type"]))).alias("llm_unique_span_field_types"),
    )


def islands_by_window(spans: DataFrame, key: str) -> DataFrame:
    """For a table of spans (key, start, end, seq, ...): its columns and island, numbered from 1 within the key."""
    order = W.partitionBy(key).orderBy("start", "end", "seq")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")
    flagged = spans.where("start < end").withColumn("hushframe_new", new)
    return flagged.withColumn("island", F.sum("hushframe_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("hushframe_new")


def winners(islands: DataFrame, key: str) -> DataFrame:
    """One row for each island of islands_by_window(): its range, the winner's kind and detector (the last by name if all else is equal), and the sources."""
    rank = F.struct("confidence", (F.col("end") - F.col("start")).alias("n"), sensitivity(F.col("field_type")).alias("s"), (-F.col("start")).alias("a"), (-F.col("end")).alias("b"), (-F.col("seq")).alias("d"), "field_type", "detector")
    best = F.max_by(F.struct("field_type", "detector", "confidence"), rank)
    rows = islands.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("best"), F.array_sort(F.collect_set(source(F.col("detector")))).alias("sources"), F.count("*").alias("n_spans"))
    return rows.select(key, "island", "start", "end", "best.*", "sources", "n_spans")
