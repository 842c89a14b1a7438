"""The whole way of a note: spans, clusters, rewrite, verification, in one lazy plan without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.normalize import normalized_places_all
from hushframe.functions.spans import NO_SPANS, folded
from hushframe.operators.detect import detect
from hushframe.operators.resolve import above_threshold, attribution, clusters
from hushframe.operators.rewrite import hidden_types, replacements, reveal_entries, spliced
from hushframe.operators.verify import summary, verified
from hushframe.functions.steps import once
from hushframe.session import spread
from hushframe.sources.policies import Policy

#: The year that dates are compared with, unless a plan names another.
AS_OF_YEAR = 2026


_made: dict[tuple, dict[str, Column]] = {}


def _steps(policy: Policy, helped: bool, extra_spans: str | None, as_of_year: int) -> dict[str, Column]:
    """The expressions of a policy over blinded()'s own columns; making them takes longer than running them on a few rows."""
    key = (repr(policy), helped, extra_spans, as_of_year)
    if key in _made:
        return _made[key]
    raw, found, changes = F.col("hf_raw"), F.col("hf_clusters"), F.col("hf_changes")
    planted = (F.col("hf_canaries"), F.col("hf_kinds"), F.col("hf_places")) if helped else ()
    spans = detect(raw, policy, *planted, lower=F.col("hf_lower"))
    if extra_spans:
        spans = F.concat(spans, F.coalesce(F.col(extra_spans).cast(NO_SPANS), F.array().cast(NO_SPANS)))
    _made[key] = {
        "hf_lower": folded(raw),
        "hf_spans": above_threshold(spans, policy),
        "hf_clusters": clusters(F.col("hf_spans"), raw),
        "hf_changes": replacements(found, policy, as_of_year),
        "safe_text": spliced(raw, changes),
        "hidden_field_types": hidden_types(changes),
        "canary_count": F.size("hf_canaries") if helped else F.lit(0),
        "attribution": attribution(found),
        "reveal_entries": reveal_entries(changes),
        "input_sha256": F.sha2(raw, 256),
        "verification_summary": summary(F.col("verification")),
    }
    return _made[key]


def blinded(notes: DataFrame, policy: Policy, *, text: str = "raw", key: str = "artifact_id", canaries: str | None = None, kinds: str | None = None, extra_spans: str | None = None, fixture_transform: bool = True, as_of_year: int = AS_OF_YEAR, ascii_only: bool = False) -> DataFrame:
    """The notes' columns and safe_text, hidden_field_types, canary_count, attribution, reveal_entries, input_sha256,
    safe_sha256, verification, verification_status, verification_summary.

    ``canaries``, ``kinds``: parallel arrays of planted values and their kinds.  They are
    always verified; only with ``fixture_transform`` may they help to find spans.
    ``extra_spans``: an array of spans from elsewhere, such as a model's proposals.

    Defined results: a null text is empty; null arrays are empty; rows are independent,
    so repeated keys do not touch each other.
    """
    names = notes.columns
    raw = F.coalesce(F.col(text), F.lit(""))
    planted = F.coalesce(F.col(canaries), F.array().cast("array<string>")) if canaries else None
    typed = F.coalesce(F.col(kinds), F.array().cast("array<string>")) if kinds else None
    helped = canaries is not None and fixture_transform
    none = F.array().cast("array<string>")
    steps = _steps(policy, helped, extra_spans, as_of_year)
    one = spread(notes).withColumns({"hf_raw": raw, "hf_canaries": planted if planted is not None else none, "hf_kinds": typed if typed is not None else none})
    if helped:
        one = one.withColumn("hf_folded", normalized_places_all("hf_raw", "hf_canaries")).transform(once, {"hf_places": F.col("hf_folded")})
    for names_of in (("hf_lower",), ("hf_spans",), ("hf_clusters",), ("hf_changes",), ("safe_text", "hidden_field_types", "canary_count", "attribution", "reveal_entries", "input_sha256")):
        one = once(one, {name: steps[name] for name in names_of})
    five = verified(one, safe="safe_text", canaries="hf_canaries", kinds="hf_kinds", entries="reveal_entries", ascii_only=ascii_only)
    status = F.when(F.col("verification.passed"), "passed").otherwise("failed")
    out = five.withColumns({"safe_sha256": F.sha2("safe_text", 256), "verification_status": status, "verification_summary": steps["verification_summary"]})
    new = ["safe_text", "hidden_field_types", "canary_count", "attribution", "reveal_entries", "input_sha256", "safe_sha256", "verification", "verification_status", "verification_summary"]
    return out.select(*(F.col(f"`{n}`") for n in names if n not in new), *new)
