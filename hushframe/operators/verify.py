"""Verification: does a safe text still give away planted values?

Checks for each planted value: as it is, without punctuation, a meaningful word of
it, a word at edit distance 1, a number of it.  Then the text's markers, the reveal
map's originals and its consistency.  All string comparison is in a common form;
only that form may need Python (see functions.normalize), once a row.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions import patterns as P
from hushframe.functions.normalize import compact, leet, normalized, words
from hushframe.functions.numbers import digit_numbers, ranges, spelled_numbers
from hushframe.functions.steps import let, once

VERDICT_TYPE = "struct<passed:boolean,hard_leaks:int,near_leaks:int,numeric_leaks:int,reveal_map_leaks:int,coreference_errors:int,failure_ids:array<string>,warnings:array<string>>"
NAMED = ("person_name", "business_name", "model_name", "email", "")
COMPACT_KINDS = (*NAMED, "url", "file_path", "account_id")
NEAR_KINDS = ("person_name", "model_name", "")


def meaningful(comparable: Column) -> Column:
    """Words of a comparable form that say something: four letters or more, no number, not generic."""
    return F.filter(words(comparable), lambda w: (F.char_length(w) >= 4) & ~w.rlike("^[0-9]+$") & ~w.isin(*P.GENERIC_WORDS))


def exact_leak(canary: Column, safe: Column) -> Column:
    return (canary != "") & F.contains(safe, canary)


def compact_leak(canary: Column, safe: Column) -> Column:
    return (F.char_length(canary) >= 4) & F.contains(safe, canary)


def piece_leak(pieces: Column, safe: Column, safe_compact: Column) -> Column:
    # A piece is letters and digits only, so its compact form is its letters'.
    return F.exists(pieces, lambda p: F.contains(safe, p) | ((F.char_length(p) >= 6) & F.contains(safe_compact, leet(p))))


def near_words(safe: Column) -> Column:
    """The words that near matches are looked for in, from a comparable form."""
    return F.array_distinct(F.filter(words(leet(safe)), lambda w: F.char_length(w).between(3, 20) & ~w.rlike("^[0-9]+$") & ~w.isin(*P.GENERIC_WORDS)))


def near_leak(pieces: Column, safe_words: Column) -> Column:
    return F.exists(F.filter(pieces, lambda p: F.char_length(p) <= 20), lambda p: F.exists(safe_words, lambda w: (F.abs(F.char_length(p) - F.char_length(w)) <= 1) & (F.levenshtein(p, w, 1) == 1)))


def without_placeholders(safe: Column) -> Column:
    return F.regexp_replace(safe, P.PLACEHOLDER, " ")


def numeric_leak(of: Column, safe_numbers: Column, safe_ranges: Column) -> Column:
    return F.arrays_overlap(of, safe_numbers) | F.exists(of, lambda n: F.exists(safe_ranges, lambda r: n.between(r["low"], r["high"])))


def conflicts(entries: Column) -> Column:
    """Whether one original has two placeholders, or one placeholder two originals, of a kind."""
    return F.exists(entries, lambda a: F.exists(entries, lambda b: (a["field_type"] == b["field_type"]) & ((a["original_sha256"] == b["original_sha256"]) != (a["placeholder"] == b["placeholder"]))))


def mapping_conflicts(reveal_map: DataFrame, key: str = "artifact_id") -> DataFrame:
    """The same check for a table of entries: the keys with a conflict."""
    one = reveal_map.groupBy(key, "field_type", "original_sha256").agg(F.count_distinct("placeholder").alias("n"))
    two = reveal_map.groupBy(key, "field_type", "placeholder").agg(F.count_distinct("original_sha256").alias("n"))
    return one.where("n > 1").select(key).union(two.where("n > 1").select(key)).distinct()


def verified(rows: DataFrame, *, safe: str = "safe_text", canaries: str | None = "canaries", kinds: str | None = "canary_types", entries: str | None = "reveal_entries", into: str = "verification", ascii_only: bool = False) -> DataFrame:
    """The rows and a verdict of VERDICT_TYPE; null texts are empty, missing kinds turn all checks on."""
    names = rows.columns
    none = F.array().cast("array<string>")
    of = lambda name: F.coalesce(F.col(name), none) if name else none
    text = F.coalesce(F.col(safe), F.lit(""))
    values = F.transform(of(canaries), lambda c: F.coalesce(c, F.lit("")))
    shown = F.col(entries) if entries else F.array().cast("array<struct<field_type:string,original_value:string,original_sha256:string,placeholder:string>>")
    shown = F.coalesce(shown, F.array())
    # Forms, words and numbers are needed only where there is something to look for.
    needed = lambda some, value, kind: F.when(some, value).otherwise(F.array().cast(kind))
    planted = F.size("hf_values") > 0
    first = once(rows, {"hf_text": text, "hf_values": values, "hf_kinds": of(kinds), "hf_entries": shown})
    zero = once(first, {"hf_bare": F.when(planted, without_placeholders(F.col("hf_text")))})
    originals = F.transform("hf_entries", lambda e: e["original_value"])
    zero = once(zero, {"hf_strings": needed(planted | (F.size("hf_entries") > 0), F.concat(F.array("hf_text", F.coalesce("hf_bare", F.lit(""))), "hf_values", originals), "array<string>")})
    one = once(zero.withColumn("hf_forms_all", normalized(F.col("hf_strings"), ascii_only=ascii_only)), {"hf_all": F.col("hf_forms_all")})
    steps = _checks()
    out = one
    for names_of in (("hf_safe", "hf_numbers", "hf_ranges", "hf_forms", "hf_originals"), ("hf_compact", "hf_words"), ("hf_failed", "hf_warnings")):
        out = once(out, {name: steps[name] for name in names_of})
    return out.withColumn(into, steps["verdict"]).select(*(n for n in names if n != into), into)


@lru_cache(maxsize=1)
def _checks() -> dict[str, Column]:
    """The expressions of verified() over its own columns, made once."""
    planted = F.size("hf_values") > 0
    needed = lambda some, value, kind: F.when(some, value).otherwise(F.array().cast(kind))
    two = {
        "hf_safe": F.get("hf_all", F.lit(0)),
        "hf_numbers": needed(planted, F.concat(digit_numbers(F.col("hf_bare")), spelled_numbers(F.get("hf_all", F.lit(1)))), "array<double>"),
        "hf_ranges": needed(planted, ranges(F.col("hf_bare")), "array<struct<low:double,high:double>>"),
        "hf_forms": F.slice("hf_all", F.lit(3), F.size("hf_values")),
        "hf_originals": F.slice("hf_all", F.size("hf_values") + 3, F.size("hf_entries")),
    }
    three = {"hf_compact": F.when(planted, compact(F.col("hf_safe"))), "hf_words": needed(planted, near_words(F.col("hf_safe")), "array<string>")}
    found, shown_safe = F.col("hf_safe"), F.col("hf_entries")

    def canary(c: Column, i: Column) -> Column:
        return let(F.struct(c.alias("c"), F.get("hf_forms", i).alias("form"), F.coalesce(F.get("hf_kinds", i), F.lit("")).alias("kind")), lambda x: let(meaningful(x["form"]), lambda pieces: let(F.array_distinct(F.concat(digit_numbers(x["c"]), spelled_numbers(x["form"]))), lambda amount: checked(x["form"], x["kind"], i, pieces, amount))))

    def checked(form: Column, kind: Column, i: Column, pieces: Column, amount: Column) -> Column:
        exact = exact_leak(form, found)
        no_marks = ~exact & kind.isin(*COMPACT_KINDS) & let(compact(form), lambda x: compact_leak(x, F.col("hf_compact")))
        piece = kind.isin(*NAMED) & piece_leak(pieces, found, F.col("hf_compact"))
        near = kind.isin(*NEAR_KINDS) & near_leak(pieces, F.col("hf_words"))
        numeric = numeric_leak(amount, F.col("hf_numbers"), F.col("hf_ranges"))
        return F.array(*(F.struct(F.when(test, F.format_string(f"canary_%d:{name}", i + 1)).alias("id"), F.lit(group).alias("group")) for name, group, test in (("exact_or_substring", "hard", exact), ("punctuation_normalized", "hard", no_marks), ("meaningful_piece", "hard", piece), ("near_match", "near", near), ("numeric", "numeric", numeric))))

    def entry(e: Column, i: Column) -> Column:
        form = F.get("hf_originals", i)
        inside = (F.char_length(compact(form)) >= 3) & F.contains(found, form)
        hint = F.exists(meaningful(form), lambda p: F.contains(F.lower(e["placeholder"]), p))
        return F.array(*(F.struct(F.when(test, F.format_string(f"reveal_entry_%d:{name}", i + 1)).alias("id"), F.lit("reveal").alias("group")) for name, test in (("original_in_safe", inside), ("placeholder_hint", hint))))

    marker = F.array(F.struct(F.when(F.col("hf_text").rlike(P.SENTINEL_SAFE), "sentinel:unsafe_marker").alias("id"), F.lit("reveal").alias("group")))
    mapping = F.array(F.struct(F.when(conflicts(shown_safe), "coreference:mapping_conflict").alias("id"), F.lit("coreference").alias("group")))
    checks = F.concat(marker, F.flatten(F.transform("hf_values", canary)), F.flatten(F.transform("hf_entries", entry)), mapping)
    warnings = F.filter(F.transform("hf_entries", lambda e, i: F.when(~e["placeholder"].rlike(P.APPROVED_PLACEHOLDER), F.format_string("placeholder_pattern_%d", i + 1))), lambda w: w.isNotNull())
    four = {"hf_failed": F.filter(checks, lambda x: x["id"].isNotNull()), "hf_warnings": warnings}
    count = lambda group: F.size(F.filter("hf_failed", lambda x: x["group"] == group))
    verdict = F.struct(
        (F.size("hf_failed") == 0).alias("passed"),
        count("hard").alias("hard_leaks"),
        count("near").alias("near_leaks"),
        count("numeric").alias("numeric_leaks"),
        count("reveal").alias("reveal_map_leaks"),
        count("coreference").alias("coreference_errors"),
        F.transform("hf_failed", lambda x: x["id"]).alias("failure_ids"),
        F.col("hf_warnings").alias("warnings"),
    )
    return two | three | four | {"verdict": verdict}


def summary(verdict: Column) -> Column:
    """One line, as logs hold it."""
    flag = F.when(verdict["passed"], "True").otherwise("False")
    return F.format_string("passed=%s; hard=%d; near=%d; numeric=%d; reveal_map=%d; coreference=%d; warnings=%d", flag, verdict["hard_leaks"], verdict["near_leaks"], verdict["numeric_leaks"], verdict["reveal_map_leaks"], verdict["coreference_errors"], F.size(verdict["warnings"]))


def summary_count(line: Column, key: str) -> Column:
    """A count from such a line: what follows the first "key=", up to the next ;, 0 if that is no number."""
    after = F.substr(line, F.instr(line, f"{key}=") + len(key) + 1)
    return F.when(F.contains(line, F.lit(f"{key}=")), F.coalesce(F.trim(F.substring_index(after, ";", 1)).try_cast("int"), F.lit(0))).otherwise(0)
