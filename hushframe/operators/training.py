"""Training examples for models that propose spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.operators.proposals import span_instructions

VALIDATION = 50


def target_spans(raw: Column, canaries: Column, kinds: Column) -> Column:
    """array<struct<text, field_type, reason, confidence>>: planted values that are in the text as they are, each once."""
    listed = F.transform(canaries, lambda c, i: F.struct(c.alias("text"), F.coalesce(F.get(kinds, i), F.lit("private_note")).alias("kind"), (F.array_position(canaries, c) == i + 1).alias("first")))
    usable = F.filter(listed, lambda x: F.coalesce(x["text"] != "", F.lit(False)) & x["first"] & F.contains(raw, x["text"]))
    return F.transform(usable, lambda x: F.struct(x["text"].alias("text"), x["kind"].alias("field_type"), F.concat(F.lit("sensitive "), F.replace(x["kind"], F.lit("_"), F.lit(" "))).alias("reason"), F.lit(0.9).alias("confidence")))


def examples(cases: DataFrame, extra: DataFrame | None = None, *, prompt_profile: str | None = None) -> DataFrame:
    """(line_no, input, target) of all cases with a text; ``extra`` cases come after the others."""
    rows = cases.withColumn("hf_part", F.lit(0))
    if extra is not None:
        rows = rows.unionByName(extra.withColumn("hf_part", F.lit(1)), allowMissingColumns=True)
    none = F.array().cast("array<string>")
    spans = target_spans(F.col("raw"), F.coalesce("canaries", none), F.coalesce("expected_field_types", none))
    return rows.where("raw is not null").select("hf_part", "line_no", F.concat(F.lit(span_instructions(prompt_profile)), F.col("raw")).alias("input"), F.to_json(F.struct(spans.alias("spans"))).alias("target"))


def split(rows: DataFrame, last: int = VALIDATION) -> DataFrame:
    """(input, target, split): the last rows are val, the others train."""
    # A rank is needed for the last rows only: the threshold row is found by a top-k, not by sorting all rows in one task.
    edge = rows.orderBy(F.desc("hf_part"), F.desc("line_no")).limit(last).select(F.struct("hf_part", "line_no").alias("at")).agg(F.min("at").alias("at"))
    return rows.withColumn("hf_edge", edge.scalar()).select("line_no", "input", "target", F.when(F.struct("hf_part", "line_no") >= F.col("hf_edge"), "val").otherwise("train").alias("split"))
