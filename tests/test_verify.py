"""What the verifier finds, and what it must not."""

import pytest
from pyspark.sql import functions as F

from hushframe.functions.normalize import comparable
from hushframe.functions.numbers import ranges, spelled_numbers
from hushframe.operators import verify

ENTRY = "struct<field_type:string,original_value:string,original_sha256:string,placeholder:string>"


def verdict(spark, safe, canaries=(), kinds=(), entries=(), **more):
    df = spark.createDataFrame([(safe, list(canaries), list(kinds), list(entries))], f"safe_text string, canaries array<string>, canary_types array<string>, reveal_entries array<{ENTRY}>")
    return verify.verified(df, **more).first().verification


def test_safe_text_passes(spark):
    assert verdict(spark, "Person_1 has a modest daily budget.", ["Bob Calder", "$75/day"], ["person_name", "budget"]).passed


@pytest.mark.parametrize("safe", ["Client still has 75 per day.", "Client still has seventy five per day.", "Client still has 70-80 per day."])
def test_numbers_leak(spark, safe):
    out = verdict(spark, safe, ["$75/day"], ["budget"])
    assert not out.passed and out.numeric_leaks >= 1


def test_placeholders_are_no_numbers(spark):
    assert verdict(spark, "Person_75 is here", ["$75/day"], ["budget"]).numeric_leaks == 0


def test_lookalikes_leak(spark):
    out = verdict(spark, "Smіth-Roofing is still visible.", ["Smith Roofing"], ["business_name"])
    assert not out.passed and out.hard_leaks >= 1


def test_compact_form_depends_on_kind(spark):
    safe, value = "a private contextual note", "private-contextual"
    assert verdict(spark, safe, [value], ["private_note"]).passed
    assert not verdict(spark, safe, [value], [""]).passed
    assert not verdict(spark, safe, [value], []).passed


def test_short_originals_are_no_leak(spark):
    assert verdict(spark, "a business budget amount", entries=[("person_name", "B", "h", "Person_1")]).passed
    assert verdict(spark, "Email_1 wrote", entries=[("email", "contact@email.test", "h", "Email_1")]).passed


def test_near_match(spark):
    out = verdict(spark, "B0b Calder is still visible.", ["Bob Calder"], ["person_name"])
    assert not out.passed and out.hard_leaks + out.near_leaks >= 1
    assert verdict(spark, "Caldes is here.", ["Bob Calder"], ["person_name"]).near_leaks == 1


def test_pieces_count_once_a_canary_and_beside_the_whole(spark):
    out = verdict(spark, "bob calder hartwell", ["Bob Calder Hartwell"], ["person_name"])
    assert out.hard_leaks == 2 and out.failure_ids == ["canary_1:exact_or_substring", "canary_1:meaningful_piece"]


def test_markers_entries_and_conflicts_in_order(spark):
    entries = [("person_name", "Bob Calder", "h1", "Person_1"), ("person_name", "Mary", "h2", "Person_1"), ("person_name", "Calder", "h3", "Calder_2")]
    out = verdict(spark, "DEBUG_RAW bob calder", entries=entries)
    assert out.failure_ids == ["sentinel:unsafe_marker", "reveal_entry_1:original_in_safe", "reveal_entry_3:original_in_safe", "reveal_entry_3:placeholder_hint", "coreference:mapping_conflict"]
    assert out.reveal_map_leaks == 4 and out.coreference_errors == 1 and out.warnings == ["placeholder_pattern_3"]


def test_conflicts_of_a_table(spark):
    rows = spark.createDataFrame([("a", "p", "h1", "P1"), ("a", "p", "h1", "P2"), ("b", "p", "h1", "P1"), ("b", "q", "h1", "P2"), ("c", "p", "h1", "P1"), ("c", "p", "h2", "P1")], "artifact_id string, field_type string, original_sha256 string, placeholder string")
    assert {r.artifact_id for r in verify.mapping_conflicts(rows).collect()} == {"a", "c"}


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, None, None, None)], f"safe_text string, canaries array<string>, canary_types array<string>, reveal_entries array<{ENTRY}>")
    assert verify.verified(df).first().verification.passed
    assert verdict(spark, "", ["", None], ["", None]).passed
    assert verify.verified(df.limit(0)).collect() == []


def test_clashing_names_are_replaced(spark):
    df = spark.createDataFrame([("x", 1)], "safe_text string, verification int")
    out = verify.verified(df, canaries=None, kinds=None, entries=None)
    assert out.columns == ["safe_text", "verification"] and out.first().verification.passed


def test_summary_and_back(spark):
    df = spark.createDataFrame([("75",)], "safe_text string").withColumns({"canaries": F.array(F.lit("$75/day")), "canary_types": F.array(F.lit("budget"))})
    line = verify.verified(df, entries=None).select(verify.summary(F.col("verification")).alias("s"))
    assert line.first().s == "passed=False; hard=0; near=0; numeric=1; reveal_map=0; coreference=0; warnings=0"
    assert line.select(verify.summary_count(F.col("s"), "numeric"), verify.summary_count(F.col("s"), "absent")).first()[:] == (1, 0)


def test_ascii_form_is_the_full_form_of_ascii(spark):
    for value in ("A  b\tC", " x ", "", "K\n9"):
        df = spark.createDataFrame([(value,)], "v string")
        from hushframe.functions.normalize import normalized

        assert df.select(normalized(F.array("v"), ascii_only=True)[0]).first()[0] == comparable(value)


@pytest.mark.parametrize(("text", "found"), [("one hundred and five", [100.0, 5.0]), ("two thousand", [2000.0]), ("seventy five per day", [75.0]), ("nothing", []), ("hundred", [100.0]), ("zero", [0.0])])
def test_spelled_numbers(spark, text, found):
    assert spark.createDataFrame([(text,)], "v string").select(spelled_numbers(F.col("v"))).first()[0] == found


def test_ranges(spark):
    out = spark.createDataFrame([("80 to 70, 1,000-2,000 and 2024-01",)], "v string").select(ranges(F.col("v"))).first()[0]
    assert [(r.low, r.high) for r in out] == [(70.0, 80.0), (1000.0, 2000.0), (1.0, 2024.0)]
