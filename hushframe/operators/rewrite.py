"""Rewriting: clusters of a row are replaced as the policy says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.numbers import digit_numbers, spelled_amount
from hushframe.sources.policies import Policy

ENTRY_TYPE = "struct<field_type:string,original_value:string,original_sha256:string,placeholder:string>"


def redacted(field_type: Column) -> Column:
    return F.concat(F.lit("[REDACTED_"), F.upper(field_type), F.lit("]"))


def generalized_budget(value: Column) -> Column:
    lower = F.lower(value)
    amount = F.coalesce(F.get(digit_numbers(value), F.lit(0)), spelled_amount(lower))
    monthly = F.when(amount < 500, "a small monthly budget").when(amount <= 1500, "a modest monthly budget").otherwise("a significant monthly budget")
    daily = F.when(amount < 50, "a small daily budget").when(amount <= 150, "a modest daily budget").when(amount <= 500, "a significant daily budget").otherwise("a business budget amount")
    return F.when(amount.isNull(), "a business budget amount").when(lower.rlike("%|commission"), "a private commission arrangement").when(lower.rlike("month|/mo|mrr"), monthly).otherwise(daily)


def generalized_date(value: Column, as_of_year: int) -> Column:
    """A year is in the future of ``as_of_year``, which is given: results do not depend on the day."""
    year = F.regexp_extract(value, r"(?U)\b(20\d{2})\b", 1).try_cast("int")
    return F.when(F.lower(value).contains("deadline"), "a deadline").when(year > as_of_year, "a future date").otherwise("a recent date")


def generalized(field_type: Column, value: Column, as_of_year: int) -> Column:
    return (
        F.when(field_type.isin("exact_price", "budget"), generalized_budget(value))
        .when(field_type == "location", "a regional location")
        .when(field_type == "date", generalized_date(value, as_of_year))
        .when(field_type == "client_status", "a private client status")
        .when(field_type == "business_relationship", "a private business relationship")
        .when(field_type == "private_note", "a private contextual note")
        .otherwise(F.concat(F.lit("a private "), F.replace(field_type, F.lit("_"), F.lit(" "))))
    )


def placeholder(fmt: Column, n: Column) -> Column:
    return F.replace(fmt, F.lit("{n}"), n.cast("string"))


def replacements(found: Column, policy: Policy, as_of_year: int) -> Column:
    """array<struct<start, end, field_type, op, original, replacement>> of the clusters that change, in text order.

    Numbers are given from the end of the text: the distinct original that occurs
    last in it is 1, by kind and with case.
    """
    changed = F.filter(found, lambda c: F.coalesce(policy.op(c["field_type"]), F.lit("ignore")) != "ignore")
    numbered = F.filter(F.reverse(changed), lambda c: policy.op(c["field_type"]) == "pseudonymize")

    def one(c: Column) -> Column:
        op = policy.op(c["field_type"])
        originals = F.array_distinct(F.transform(F.filter(numbered, lambda x: x["field_type"] == c["field_type"]), lambda x: x["text"]))
        new = F.when(op == "redact", redacted(c["field_type"])).when(op == "pseudonymize", placeholder(policy.format(c["field_type"]), F.array_position(originals, c["text"]))).otherwise(generalized(c["field_type"], c["text"], as_of_year))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["field_type"].alias("field_type"), op.alias("op"), c["text"].alias("original"), new.alias("replacement"))

    return F.transform(changed, one)


def spliced(text: Column, changes: Column) -> Column:
    """The text with its ranges replaced; ranges are disjoint and in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, c: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, c["start"] - acc["at"]), c["replacement"]).alias("out"), c["end"].alias("at"))
    return F.aggregate(changes, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))


def hidden_types(changes: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(changes, lambda c: c["field_type"])))


def reveal_entries(changes: Column) -> Column:
    """array<ENTRY_TYPE>: what placeholders stand for, ordered by kind and placeholder."""
    some = F.filter(changes, lambda c: c["op"] == "pseudonymize")
    rows = F.transform(some, lambda c: F.struct(c["field_type"].alias("field_type"), c["replacement"].alias("placeholder"), c["original"].alias("original_value")))
    ordered = F.array_sort(F.array_distinct(rows))
    return F.transform(ordered, lambda e: F.struct(e["field_type"].alias("field_type"), e["original_value"].alias("original_value"), F.sha2(e["original_value"], 256).alias("original_sha256"), e["placeholder"].alias("placeholder")))


def revealed(text: Column, entries: Column, *, longest_first: bool = False) -> Column:
    """The text with placeholders turned back.

    By default in the entries' order, where a placeholder is also replaced inside a
    longer one (Person_1 in Person_10); longest_first avoids that.
    """
    if longest_first:
        entries = F.transform(F.array_sort(F.transform(entries, lambda e: F.struct((-F.char_length(e["placeholder"])).alias("n"), e.alias("e")))), lambda x: x["e"])
    return F.aggregate(entries, text, lambda acc, e: F.replace(acc, e["placeholder"], e["original_value"]))
