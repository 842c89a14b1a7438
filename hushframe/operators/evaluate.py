"""Evaluation of whole suites: every case through its lanes, then totals.

Lanes (detectors only; with a model; with the planted values' help) are columns of one
row, so comparing them needs no join.  Calls of a model depend on the order of cases:
the first n are asked, and none after a failed call.  They are made in waves of line
ranges, each twice as long as the one before, so a failure costs no more further calls
than there were successful ones (and ``WAVE``); a wave's replies are written to the checkpoint folder,
so no case is asked again by what is computed later.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.spans import no_spans
from hushframe.functions.steps import once
from hushframe.operators.proposals import STATS, Client, graded, judged, proposed
from hushframe.plans.blind import AS_OF_YEAR, blinded
from hushframe.session import kept
from hushframe.sources.policies import Policy

#: Cases of the first wave of calls, and cases whose places in the order are looked up exactly.
WAVE = 8
EXACT = 4096


def nearest_rank(values: Column, percentile: float) -> Column:
    """Of a sorted array, the value at the rounded place (halves to even); 0 if it is empty."""
    at = F.bround((F.size(values) - 1) * F.lit(percentile / 100.0)).cast("int")
    return F.when(F.size(values) > 0, F.get(values, at)).otherwise(F.lit(0.0))


def nearest_rank_counted(counted: Column, percentile: float) -> Column:
    """As nearest_rank(), of a sorted array<struct<v, n>> that holds each value once with its number."""
    total = F.aggregate(counted, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    at = F.bround((total - 1) * F.lit(percentile / 100.0)).cast("long")
    # The place is part of what is folded: within the step it would be counted anew for every value.
    start = F.struct(F.lit(0).cast("long").alias("seen"), at.alias("at"), F.lit(None).cast("double").alias("v"))
    step = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), a["at"].alias("at"), F.when(a["v"].isNotNull() | (a["seen"] + x["n"] <= a["at"]), a["v"]).otherwise(x["v"].cast("double")).alias("v"))
    return F.coalesce(F.aggregate(counted, start, step, lambda a: a["v"]), F.lit(0.0))


def first_cases(rows: DataFrame, n: int | None, eligible: Column | None = None, order: str = "line_no") -> DataFrame:
    """The first n eligible cases by their line numbers, which are unique; null n: all of them. No more than n numbers go to one task."""
    some = rows if eligible is None else rows.where(eligible)
    if n is None:
        return some
    last = some.select(order).orderBy(order).limit(n).agg(F.max(order))
    return some.where(F.col(order) <= last.scalar())


def breaker(rows: DataFrame, failed: Column, order: str = "line_no") -> DataFrame:
    """The rows and disabled: whether a call failed for an earlier case, after which no more count."""
    first = rows.where(failed).agg(F.min(order))
    return rows.withColumn("disabled", F.coalesce(F.col(order) > first.scalar(), F.lit(False)))


def waves(rows: DataFrame, order: str = "line_no") -> Iterator[int]:
    """The last line numbers of the waves: of ``WAVE`` rows, then twice as many each time (exactly up to ``EXACT`` rows, some more or less after)."""
    lines = [r[0] for r in rows.select(order).orderBy(order).limit(EXACT).collect()]
    at, size = 0, WAVE
    while at + size < len(lines):
        at, size = at + size, 2 * size
        yield lines[at - 1]
    if len(lines) < EXACT:
        if lines:
            yield lines[-1]
        return
    total = rows.count()
    shares = []
    while at + size < total:
        at, size = at + size, 2 * size
        shares.append(at / total)
    rest = rows.agg(F.percentile_approx(order, [*shares, 1.0], 100_000)).first()[0]
    yield from (x for x in rest[:-1] if x > lines[-1])
    yield rows.agg(F.max(order)).first()[0]


def called(rows: DataFrame, ask: Callable[[DataFrame], DataFrame], failed: Column, *, stop: bool = True, order: str = "line_no") -> tuple[DataFrame | None, int | None, int | None]:
    """ask(some rows), wave after wave: the answered rows so far, the last line asked, and the first line that failed.

    With ``stop``, no wave follows one in which a call failed.
    """
    done: list[DataFrame] = []
    low = broken = None
    for high in waves(rows, order):
        some = rows.where(F.col(order) <= high) if low is None else rows.where((F.col(order) > low) & (F.col(order) <= high))
        done.append(kept(ask(some)))
        low = high
        broken = done[-1].where(failed).agg(F.min(order)).first()[0]
        if stop and broken is not None:
            break
    return reduce(DataFrame.unionByName, done) if done else None, low, broken


def with_replies(rows: DataFrame, ask: Callable[[DataFrame], DataFrame], max_cases: int | None, required: bool) -> DataFrame:
    """The rows, llm_used, llm_spans, the counters of STATS, llm_latency_ms and process_failed.

    After a failed call (in line order) the cases go without the model; ``required``: then
    there is no such end, and each case whose call fails is a failure of the process.
    """
    failed = (F.col("llm_timeouts") > 0) | (F.col("llm_transport_failures") > 0)
    answered, last, broken = called(first_cases(rows, max_cases), ask, failed, stop=not required)
    nothing = {"llm_used": F.lit(False)} | {x: F.lit(0) for x in STATS} | {"llm_latency_ms": F.lit(None).cast("double"), "llm_spans": no_spans(), "process_failed": F.lit(False)}
    if answered is None:
        return rows.withColumns(nothing)
    used = F.lit(True) if required or broken is None else F.col("line_no") <= broken
    some = answered.withColumns({"process_failed": F.lit(required) & failed, "llm_used": used} | {x: F.when(used, F.col(x)).otherwise(0) for x in STATS} | {"llm_latency_ms": F.when(used, F.col("llm_latency_ms")), "llm_spans": F.when(used & ~failed, F.col("llm_spans"))})
    return some.unionByName(rows.where(F.col("line_no") > last).withColumns(nothing))


def clock() -> Column:
    """Nanoseconds, read anew for every row."""
    return F.expr("cast(reflect('java.lang.System', 'nanoTime') AS long)")


def evaluated(cases: DataFrame, policy: Policy, *, fixture_transform: bool = True, client: Client | None = None, grade: bool = False, triage: bool = False, prompt_profile: str | None = None, max_cases: int | None = None, required: bool = False, stem: str = "suite", as_of_year: int = AS_OF_YEAR, ascii_only: bool = False) -> DataFrame:
    """One row for each case that is not broken: blinded()'s columns for the lane that counts, the other lanes' verdicts, and latency_ms.

    ``cases``: of read_cases() or generated_cases().  With a client, its calls are made now
    (at most ``max_cases``), and cases after the first failed call go without its spans.
    latency_ms is the time from where a case enters the lanes to its verdicts, with what it
    waits for others of its batch, and the model's.
    """
    rows = cases.where(~F.col("broken")) if "broken" in cases.columns else cases
    rows = rows.withColumn("artifact_id", F.concat(F.lit(f"art_{artifact_stem(stem)}_"), F.col("case_id")))
    lane = lambda df, **more: blinded(df, policy, canaries="canaries", kinds="expected_field_types", as_of_year=as_of_year, ascii_only=ascii_only, **more)
    if client is None:
        begun = rows.withColumns({"llm_used": F.lit(False), "process_failed": F.lit(False)} | {x: F.lit(0) for x in STATS} | {"llm_latency_ms": F.lit(None).cast("double")})
        out = lane(once(begun, {"hf_begun": clock()}), fixture_transform=fixture_transform)
        out = out.withColumns({"det_passed": F.lit(None).cast("boolean"), "det_safe_text": F.lit(None).cast("string")})
    else:
        ask = (lambda df: graded(df, client, policy, triage=triage)) if grade else (lambda df: proposed(df, client, prompt_profile=prompt_profile))
        voted = once(with_replies(rows, ask, max_cases, required), {"hf_begun": clock()})
        det = lane(voted, fixture_transform=fixture_transform).withColumns({"det_passed": F.when(F.col("llm_used"), F.col("verification.passed")), "det_safe_text": F.when(F.col("llm_used"), F.col("safe_text"))})
        out = lane(det, fixture_transform=fixture_transform, extra_spans="llm_spans")
    if not fixture_transform:
        mine = [c for c in out.columns if c not in rows.columns]
        helped = lane(out.withColumn("hf_lane", F.struct(*mine)).drop(*mine)).withColumn("fixture_passed", F.col("verification.passed"))
        out = helped.select(*rows.columns, "hf_lane.*", "fixture_passed")
    else:
        out = out.withColumn("fixture_passed", F.lit(None).cast("boolean"))
    return out.withColumn("latency_ms", (clock() - F.col("hf_begun")) / 1e6 + F.coalesce("llm_latency_ms", F.lit(0.0))).drop("hf_begun")


def artifact_stem(stem: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in stem).strip("_")


def mode_suffix(*, llm_mode: str = "none", judge: str = "none", fixture_transform: bool = True, prompt_profile: str = "strict_span_v1", strategy: str = "propose", verdicts: str = "binary") -> str:
    """What a run's settings add to the names of its files."""
    parts = ["fixture_off"] * (not fixture_transform)
    if llm_mode != "none":
        parts.append(f"llm_{llm_mode}")
        if strategy == "grade":
            parts += ["grade", verdicts]
        elif prompt_profile != "strict_span_v1":
            parts.append(prompt_profile)
    parts += [f"judge_{judge}"] * (judge != "none")
    return "." + ".".join(parts) if parts else ""


# Names of totals.
COUNTERS = ("hard_leaks", "near_leaks", "numeric_leaks", "reveal_map_leaks", "coreference_errors")
REMOVED = ("removed_by_fixture_canary", "removed_by_detector", "removed_by_llm", "removed_by_combined", "llm_unique_spans_accepted")


def totals(results: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """One row of counters over evaluated() rows; ``cases``: with the broken ones, which count as failures of the process.

    Rows are counted by their latencies first (a call's to a microsecond, a case's to a tenth
    of a millisecond), so what is listed for the percentiles is each value once.
    """
    passed, det, ok = F.col("verification.passed"), F.col("det_passed"), ~F.col("process_failed")
    changed = F.coalesce(F.col("det_safe_text") != F.col("safe_text"), F.lit(False))
    count = lambda test: F.count_if(ok & test)
    total = lambda x: F.coalesce(F.sum(F.when(ok, F.col(x))), F.lit(0))
    sums = {
        "cases_total": F.count("*"),
        "process_failures": F.count_if(~ok),
        "cases_passed": count(passed),
        **{c: total(f"verification.{c}") for c in COUNTERS},
        "over_redaction_warnings": F.coalesce(F.sum(F.when(ok, F.size(F.filter("verification.warnings", lambda w: F.contains(w, F.lit("over")))))), F.lit(0)),
        **{c: total(f"attribution.{c}") for c in REMOVED},
        **{c: F.coalesce(F.sum(c), F.lit(0)) for c in STATS},
        "cases_where_llm_changed_output": count(changed),
        "cases_where_llm_prevented_failure": count(changed & ~det & passed),
        "cases_where_llm_caused_failure": count(changed & det & ~passed),
        "cases_failed_without_fixture_transform": count(~passed & F.col("fixture_passed").isNotNull()),
        "cases_where_fixture_would_have_saved": count(~passed & F.col("fixture_passed")),
        "hf_safe": F.sum(F.when(ok, F.char_length("safe_text")).cast("long")),
        "hf_raw": F.sum(F.when(ok, F.char_length("raw")).cast("long")),
    }
    kinds = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    added = kinds(F.transform("llm_spans", lambda x: x["field_type"])) if "llm_spans" in results.columns else F.array().cast("array<string>")
    by_time = results.groupBy(F.round(F.when(ok, F.col("latency_ms")), 1).alias("hf_case"), F.round("llm_latency_ms", 3).alias("hf_call"))
    parts = by_time.agg(*(v.alias(k) for k, v in sums.items()), kinds(F.when(ok, F.col("attribution.llm_unique_span_field_types"))).alias("llm_unique_span_field_types"), added.alias("llm_added_field_types"))
    listed = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("cases_total").alias("n")))))
    rows = parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums), listed("hf_case").alias("hf_cases"), listed("hf_call").alias("hf_calls"), *(F.array_sort(kinds(c)).alias(c) for c in ("llm_unique_span_field_types", "llm_added_field_types")))
    # The same value may be listed for several values of the other latency; the ranks do not mind.
    rank = lambda c, p: F.round(nearest_rank_counted(F.col(c), p), 3)
    length = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("cases_total") - F.col("process_failures")), F.lit(0.0)), 3)
    out = rows.select(
        *(c for c in sums if not c.startswith("hf_") and c != "process_failures"),
        length("hf_safe").alias("avg_safe_chars"),
        length("hf_raw").alias("avg_raw_chars"),
        rank("hf_cases", 50).alias("p50_latency_ms"),
        rank("hf_cases", 95).alias("p95_latency_ms"),
        F.coalesce(F.try_element_at("hf_cases", F.lit(-1))["v"], F.lit(0.0)).alias("max_latency_ms"),
        rank("hf_calls", 50).alias("p50_llm_latency_ms"),
        rank("hf_calls", 95).alias("p95_llm_latency_ms"),
        "llm_unique_span_field_types",
        "llm_added_field_types",
        F.col("process_failures").alias("json_or_process_failures"),
    )
    if cases is not None and "broken" in cases.columns:
        broken = cases.agg(F.count_if("broken")).scalar()
        out = once(out, {"hf_broken": broken}).withColumns({"json_or_process_failures": F.col("json_or_process_failures") + F.col("hf_broken"), "cases_total": F.col("cases_total") + F.col("hf_broken")}).drop("hf_broken")
    return out


def usefulness(results: DataFrame, client: Client, *, max_cases: int | None = None) -> DataFrame:
    """One row: the judge's scores over the first cases that passed; after a failed reply no more are judged. The calls are made now."""
    chosen = first_cases(results, max_cases, F.col("verification.passed")).select("line_no", "safe_text", "expected_semantics")
    chosen = kept(chosen)
    rows, _, broken = called(chosen, lambda df: judged(df, client), ~F.col("judged_ok"))
    if rows is None:
        rows = judged(chosen, client)
    if broken is not None:
        rows = rows.where(F.col("line_no") <= broken)
    parts = rows.groupBy("judged_score").agg(F.count_if("judged_ok").alias("n"), F.count_if("judged_overredaction").alias("over"), F.sum("judged_missing").alias("missing"), F.count_if(~F.col("judged_ok")).alias("failed"))
    scores = F.array_sort(F.collect_list(F.when(F.col("judged_score").isNotNull(), F.struct(F.col("judged_score").alias("v"), "n"))))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    summed = parts.agg(total("n").alias("usefulness_cases_judged"), scores.alias("s"), F.sum(F.col("judged_score") * F.col("n")).alias("all"), total("over").alias("overredaction_count"), total("missing").alias("missing_semantics_count"), total("failed").alias("usefulness_failures"))
    average = F.coalesce(F.try_divide("all", "usefulness_cases_judged"), F.lit(0.0))
    out = summed.select("usefulness_cases_judged", F.round(average, 3).alias("usefulness_avg_score"), F.round(nearest_rank_counted(F.col("s"), 50), 3).alias("usefulness_p50"), F.round(nearest_rank_counted(F.col("s"), 10), 3).alias("usefulness_p10"), "overredaction_count", "missing_semantics_count", "usefulness_failures")
    return out.withColumns({new: F.col(old) for new, old in ALSO.items()})


def per_case(results: DataFrame) -> DataFrame:
    """What is written for each case: verdict and counts, no text."""
    ok = ~F.col("process_failed")
    ids = F.when(ok, F.col("verification.failure_ids")).otherwise(F.array(F.lit("process_failure:RuntimeError")))
    return results.select("case_id", "artifact_id", (ok & F.col("verification.passed")).alias("verification_passed"), F.when(ok, F.col("verification_summary")).alias("verification_summary"), ids.alias("sanitized_failure_ids"), "hidden_field_types", F.round("latency_ms", 3).alias("latency_ms"), F.struct(*(x for x in STATS)).alias("llm"))


# Other names of the judge's totals.
ALSO = {"usefulness_p50_score": "usefulness_p50", "usefulness_p10_score": "usefulness_p10", "usefulness_overredaction_count": "overredaction_count", "usefulness_missing_semantics_count": "missing_semantics_count", "cases_where_llm_overredacted": "overredaction_count"}
# Totals that may be shown, in the order in which they are.
PUBLIC = ("cases_total", "cases_passed", *COUNTERS[:4], "json_or_process_failures", "p50_latency_ms", "p95_latency_ms", "max_latency_ms", "avg_safe_chars", "avg_raw_chars", "over_redaction_warnings", "coreference_errors", *STATS, "llm_added_field_types", "p50_llm_latency_ms", "p95_llm_latency_ms", *REMOVED, "llm_unique_span_field_types", "cases_where_llm_changed_output", "cases_where_llm_prevented_failure", "cases_where_llm_caused_failure", "cases_where_llm_overredacted", "cases_where_fixture_would_have_saved", "cases_failed_without_fixture_transform", "usefulness_cases_judged", "usefulness_avg_score", "usefulness_p50", "usefulness_p10", "usefulness_p50_score", "usefulness_p10_score", "overredaction_count", "missing_semantics_count", "usefulness_overredaction_count", "usefulness_missing_semantics_count", "usefulness_failures")


def public(metrics: DataFrame) -> DataFrame:
    """Those of the totals that may be shown."""
    return metrics.select([c for c in PUBLIC if c in metrics.columns])


def summary_line(metrics: DataFrame, name: str, *, with_model: bool = False) -> DataFrame:
    """(name, line): one suite in a line; missing totals are 0."""
    value = lambda c: F.col(c).cast("string") if c in metrics.columns else F.lit("0")
    shown = [("hard", "hard_leaks"), ("near", "near_leaks"), ("num", "numeric_leaks"), ("reveal", "reveal_map_leaks"), ("coref", "coreference_errors"), ("failed", "json_or_process_failures")]
    model = [("prevented", "cases_where_llm_prevented_failure"), ("caused", "cases_where_llm_caused_failure"), ("changed", "cases_where_llm_changed_output"), ("bad_json", "llm_json_failures"), ("timeouts", "llm_timeouts"), ("accepted", "llm_spans_accepted"), ("p50_ms", "p50_llm_latency_ms"), ("p95_ms", "p95_llm_latency_ms")]
    parts = [F.concat(value("cases_passed"), F.lit("/"), value("cases_total"))] + [F.concat(F.lit(f"{k}="), value(c)) for k, c in shown + model * with_model]
    return metrics.select(F.lit(name).alias("name"), F.concat_ws(" ", *parts).alias("line"))
