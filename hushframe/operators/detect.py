"""Detection: arrays of spans from text, within the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions import patterns as P
from hushframe.functions.spans import NO_SPANS, SPAN_TYPE, folded, gated, literal_spans, may_match, pattern_spans, places, span
from hushframe.sources.policies import Policy


def registry_spans(text: Column, policy: Policy, lower: Column) -> list[Column]:
    """One array for each pattern of a kind that the policy names; the rest never enter the plan."""
    return [gated(pattern_spans(text, pattern, kind, reason, confidence), may_match(text, lower, pattern)) for kind, pattern, reason, confidence in P.DETECTORS if kind in policy]


def gazetteer_spans(text: Column, policy: Policy, lower: Column) -> list[Column]:
    """One array for each gazetteer: its phrases are data of one expression, and only those that the text holds are looked for."""
    def listed(kind: str, phrases: tuple[str, ...], reason: str, confidence: float) -> Column:
        there = F.filter(F.array(*map(F.lit, phrases)), lambda x: F.contains(lower, F.lower(x)))
        return F.flatten(F.transform(there, lambda x: literal_spans(text, x, kind, reason, confidence, "heuristic")))

    known = (("location", P.LOCATIONS, "known synthetic location", 0.82), ("client_status", P.STATUS_PHRASES, "synthetic status phrase", 0.9))
    return [listed(*row) for row in known if row[0] in policy]


def looks_like_business(value: Column) -> Column:
    return value.rlike(P.BUSINESS)


def person_spans(text: Column) -> list[Column]:
    """Two capitalised words that are no business and no known place, and forms with titles or initials."""
    some = lambda pattern, reason, confidence, detector="regex": gated(pattern_spans(text, pattern, "person_name", reason, confidence, detector), may_match(text, text, pattern))
    pairs, initial = some(P.PERSON, "capitalized two-word name", 0.66, "heuristic"), some(P.NAME_INITIAL, "name + initial", 0.7)
    return [
        F.filter(pairs, lambda s: ~looks_like_business(s["text"]) & ~s["text"].isin(*P.NOT_PERSONS)),
        some(P.TITLE_NAME, "title + name", 0.7),
        some(P.INITIAL_SURNAME, "initial + surname", 0.7),
        F.filter(initial, lambda s: ~F.regexp_extract(s["text"], r"(?U)^\S+", 0).isin(*P.NOT_FIRST_NAMES)),
    ]


def infer_field_type(value: Column) -> Column:
    """The kind of a value by the first pattern that fits."""


    def whole(pattern: str) -> str:
        flags = pattern.index(")") + 1
        return f"{pattern[:flags]}^(?:{pattern[flags:]})\\z"

    def found(*some: str) -> Column:
        return _any(value, some)

    return (
        F.when(found(P.EMAIL), "email")
        .when(found(P.PHONE, P.LOCAL_PHONE), "phone")
        .when(found(P.URL), "url")
        .when(found(P.API_KEY, P.LABELED_API_KEY), "api_key")
        .when(found(P.LABELED_SECRET) | F.trim(value).rlike(whole(P.LONG_SECRET)), "secret_token")
        .when(found(P.FILE_PATH), "file_path")
        .when(found(P.PRICE, P.SPELLED_PRICE), "budget")
        .when(found(P.ACCOUNT), "account_id")
        .when(found(P.DATE, P.RELATIVE_DATE), "date")
        .when(looks_like_business(value), "business_name")
        .when(value.isin(*P.LOCATIONS), "location")
        .when(value.isin(*P.STATUS_PHRASES), "client_status")
        .when(value.rlike(whole(P.PERSON)), "person_name")
        .when(value.rlike(whole(P.MODEL)) | value.rlike(whole(P.MODEL_CONTEXT)), "model_name")
        .otherwise("private_note")
    )


def _any(value: Column, some: tuple[str, ...]) -> Column:
    out = value.rlike(some[0])
    for pattern in some[1:]:
        out = out | value.rlike(pattern)
    return out


def variants(canary: Column, kind: Column) -> Column:
    """Other forms in which a planted value may appear: array<string>."""
    parts = F.filter(F.split(canary, r"(?U)\s+", -1), lambda x: x != "")
    first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    initial = lambda x: F.substring(x, 1, 1)
    person = F.array(first, last, F.concat(initial(first), F.lit(". "), last), F.concat(first, F.lit(" "), initial(last), F.lit(".")))
    bob = F.array(F.lit("Bobby"), F.concat(F.lit("B. "), last), F.concat(F.lit("Bobby "), last))
    persons = F.when(F.size(parts) >= 2, F.concat(person, F.when(first == "Bob", bob).otherwise(F.array().cast("array<string>"))))
    business = F.array(F.replace(canary, F.lit(" "), F.lit("")), F.replace(canary, F.lit(" "), F.lit("-")), F.upper(canary), F.lower(canary))
    businesses = F.concat(business, F.when(F.size(parts) >= 2, F.array(F.concat(F.lit("the "), F.lower(last), F.lit(" guy")))).otherwise(F.array().cast("array<string>")))
    budget = F.when(F.contains(canary, F.lit("$75/day")), F.array(*map(F.lit, ("seventy five per day", "70-80 per day", "$70-$80/day"))))
    some = F.when(kind == "person_name", persons).when(kind == "business_name", businesses).when(kind == "budget", budget)
    return F.filter(F.array_distinct(F.coalesce(some, F.array().cast("array<string>"))), lambda x: (x != "") & (x != canary))


def planted_spans(text: Column, canaries: Column, kinds: Column, found: Column, lower: Column) -> list[Column]:
    """Spans of a case's own planted values: as they are, in a common form, and in other forms.

    ``found``: a column of normalized_places_all(text, canaries), ``lower``: one of folded(text); not the calls, as lambdas refer to them.
    """
    typed = F.transform(canaries, lambda c, i: F.struct(c.alias("value"), F.coalesce(F.get(kinds, i), infer_field_type(c)).alias("kind")))
    with_places = F.zip_with(typed, found, lambda t, p: F.struct(t["value"].alias("value"), t["kind"].alias("kind"), p.alias("places")))

    none = F.array().cast(NO_SPANS)
    # What is all ASCII is in the text in any case only if it is in the folded text.
    may_hold = lambda x: (F.octet_length(x) != F.char_length(x)) | F.contains(lower, F.lower(x))

    def of(t: Column) -> Column:
        as_is = F.when(may_hold(t["value"]), literal_spans(text, t["value"], t["kind"], "eval fixture canary", 1.0, "fixture")).otherwise(none)
        folded = F.transform(t["places"], lambda p: span(p["start"], F.substring(text, p["start"] + 1, p["end"] - p["start"]), t["kind"], "fixture", 0.99, "eval fixture normalized canary"))
        other = F.flatten(F.transform(F.filter(variants(t["value"], t["kind"]), may_hold), lambda v: literal_spans(text, v, t["kind"], "eval fixture canary variant", 0.97, "fixture")))
        return F.concat(as_is, folded, other)

    usable = F.filter(with_places, lambda t: F.coalesce(t["value"], F.lit("")) != "")
    return [F.coalesce(F.flatten(F.transform(usable, of)), F.array().cast(NO_SPANS))]


def detect(text: Column, policy: Policy, canaries: Column | None = None, kinds: Column | None = None, found: Column | None = None, lower: Column | None = None) -> Column:
    """All spans of a text in the order in which detectors list them: array<SPAN_TYPE>.

    ``lower``: a column of folded(text), so that it is made once.
    """
    lower = folded(text) if lower is None else lower
    arrays = registry_spans(text, policy, lower) + gazetteer_spans(text, policy, lower)
    if "person_name" in policy:
        arrays += person_spans(text)
    if canaries is not None:
        arrays += planted_spans(text, canaries, kinds, found, lower)
    return F.concat(F.array().cast(NO_SPANS), *arrays)


def candidates(text: Column, policy: Policy, most: int = 14) -> Column:
    """Phrases that a model may be asked about: the ``most`` longest, of equal ones the first listed.

    A kind that the policy leaves out is replaced by the first of the three kinds that it has.
    """
    allowed = [x for x in ("business_relationship", "client_status", "private_note") if x in policy]
    if not allowed:
        return F.array().cast(NO_SPANS)
    kind = lambda x: F.lit(x if x in allowed else allowed[0])

    def trimmed(found: Column, of, reason: str) -> Column:
        def one(p: Column) -> Column:
            lead = F.char_length(p["text"]) - F.char_length(F.regexp_replace(p["text"], r"(?U)^\s+", ""))
            return span(p["start"] + lead, F.regexp_replace(p["text"], r"(?U)^\s+|\s+$", ""), of(p), "heuristic", 0.0, reason)

        return F.transform(found, one)

    groups = []
    if "business_relationship" in allowed:
        groups.append(trimmed(places(text, P.DETERMINER), lambda p: kind("business_relationship"), "candidate: determiner phrase"))
    lower = lambda p: F.lower(p["text"])
    cue = lambda p: lower(p).rlike("|".join(x.replace("-", r"\-") for x in P.CUES))
    opener = lambda p: F.regexp_replace(lower(p), r"(?U)^\s+", "").rlike("^(?:" + "|".join(P.NOTE_OPENERS) + ")")
    groups.append(trimmed(F.filter(places(text, P.CLAUSE), cue), lambda p: F.when(opener(p), kind("private_note")).otherwise(kind("client_status")), "candidate: cue clause"))
    listed = F.filter(F.concat(*groups), lambda s: s["end"] - s["start"] >= 5)
    # By place, then as listed; the first of equal places stays.
    placed = F.array_sort(F.transform(listed, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("seq"), s.alias("span"))))
    ranked = f"array<struct<size:int,seq:int,span:{SPAN_TYPE}>>"
    start = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.array().cast(ranked).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.struct((x["start"] - x["end"]).alias("size"), x["seq"].alias("seq"), x["span"].alias("span"))
        again = (acc["start"] == x["start"]) & (acc["end"] == x["end"])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(again, acc["out"]).otherwise(F.concat(acc["out"], F.array(new))).alias("out"))

    distinct = F.aggregate(placed, start, step, lambda acc: acc["out"])
    return F.transform(F.slice(F.array_sort(distinct), 1, most), lambda r: r["span"])
