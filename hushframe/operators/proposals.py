"""Spans that a model proposes or votes on.

The model is any callable prompt -> Reply that can be pickled; it runs in Python
workers, one call for each row that needs one.  Everything around the calls (prompts,
parsing, checking against the text) is built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.patterns import FIELD_TYPES
from hushframe.functions.spans import NO_SPANS
from hushframe.operators.detect import candidates
from hushframe.functions.steps import once
from hushframe.sources.policies import Policy


@dataclass(frozen=True)
class Reply:
    text: str = ""
    ok: bool = True
    timed_out: bool = False
    latency_ms: float = 0.0


Client = Callable[[str], Reply]

#: What each profile asks for; the reply's form is the same.
PROFILES = {"strict": "strict_span_v1", "contextual": "contextual_span_v2", "coreference": "coreference_span_v3"}
_ASK = {
    "strict": "List what an outsider must not learn from this note: who and where it is about, what was agreed and paid, how to get in (keys, accounts, files), when, and which tools were used.",
    "contextual": "List what gives the people behind this note away without naming them: a role that stands for a customer, a remark on a delay, a payment, a promise or a rival.",
    "coreference": "List every word that points back to someone or something private in this note: pronouns, short names, initials, titles, and turns of phrase that only fit one customer.",
}
# Forms of replies.
VERDICT_FORM = '{"verdicts":[{"i":1,"v":"hide"},{"i":2,"v":"keep"}]}'
SPAN_FORM = '{"spans":[{"text":"...","field_type":"business_relationship","reason":"contextual client reference","confidence":0.82}]}'
JUDGE_FORM = '{"semantic_preservation_score":0.0,"missing_semantics":["..."],"overredaction":false,"notes":"safe explanation only"}'


def profile(name: str | None) -> str:
    """strict, contextual or coreference, from either form of its name; strict for anything else."""
    return next((k for k, v in PROFILES.items() if name in (k, v)), "strict")


def span_instructions(name: str | None = None) -> str:
    return f"You propose sensitive spans of a note. You do not approve its release; a verifier decides.\n{_ASK[profile(name)]}\nEvery span's text must be copied exactly from the note. Return JSON only, in this form:\n{SPAN_FORM}\nNote:\n"


def vote_prompt(text: Column, listed: Column, triage: bool) -> Column:
    choice = 'Say "hide" for what an outsider must not read, "keep" for what tells them nothing' + (', "unsure" if it depends on what you do not know.' if triage else ".")
    head = f'Below are a private note and numbered phrases from it. A later check decides what is released; you only vote.\n{choice}\nGive one vote for each number, as JSON and nothing else:\n{VERDICT_FORM}\n\nNOTE:\n'
    lines = F.transform(listed, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["text"]))
    return F.concat(F.lit(head), text, F.lit("\n\nCANDIDATES:\n"), F.array_join(lines, "\n"))


REPLY_FIELDS = "reply_text string, reply_ok boolean, reply_timed_out boolean, reply_ms double"


def asked(rows: DataFrame, client: Client, prompt: str = "prompt") -> DataFrame:
    """The rows and the reply to each row's prompt; rows with a null prompt are not sent and have null replies."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", " + REPLY_FIELDS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = [None if pd.isna(p) else client(p) for p in batch[prompt]]
            yield batch.assign(reply_text=[r and r.text for r in replies], reply_ok=pd.array([None if r is None else r.ok for r in replies], dtype="boolean"), reply_timed_out=pd.array([None if r is None else r.timed_out for r in replies], dtype="boolean"), reply_ms=[None if r is None else r.latency_ms for r in replies])

    return rows.mapInPandas(run, schema)


def json_object(text: Column, schema: str) -> Column:
    """The whole text as JSON, else from its first { to its last }; null if neither can be read."""
    first = schema.split()[0]
    whole, inner = F.from_json(text, schema), F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)
    return F.coalesce(F.when(whole[first].isNotNull(), whole), F.when(inner[first].isNotNull(), inner))


def parsed_spans(reply: Column, text: Column) -> Column:
    """struct<spans, proposed, accepted, rejected, json_failure> of a reply.

    A span needs a text that is in the note (its first place counts) and a known
    kind; confidences are put between 0 and 1, 0.5 if missing; of equal ones the first
    stays.
    """
    raw = json_object(reply, "spans array<string>")["spans"]
    items = F.transform(raw, lambda x: F.struct(F.from_json(x, "text string, field_type string, reason string, confidence string").alias("s")))
    good = F.filter(items, lambda s: F.coalesce(F.trim(s["s"]["text"]) != "", F.lit(False)) & F.coalesce(s["s"]["field_type"].isin(*FIELD_TYPES), F.lit(False)) & (F.coalesce(F.position(s["s"]["text"], text), F.lit(0)) > 0))

    def one(s: Column) -> Column:
        begin = F.position(s["s"]["text"], text) - 1
        confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(s["s"]["confidence"].try_cast("double"), F.lit(0.5))))
        return F.struct(begin.cast("int").alias("start"), (begin + F.char_length(s["s"]["text"])).cast("int").alias("end"), s["s"]["text"].alias("text"), s["s"]["field_type"].alias("field_type"), F.lit("llm").alias("detector"), confidence.alias("confidence"), F.substring(F.coalesce(s["s"]["reason"], F.lit("llm proposed sensitive span")), 1, 160).alias("reason"))

    listed = F.transform(good, one)
    distinct = F.filter(F.transform(listed, lambda s, i: F.struct(s.alias("s"), F.exists(F.slice(listed, F.lit(1), i), lambda o: (o["start"] == s["start"]) & (o["end"] == s["end"]) & (o["field_type"] == s["field_type"])).alias("again"))), lambda x: ~x["again"])
    spans = F.transform(distinct, lambda x: x["s"])
    none = F.array().cast(NO_SPANS)
    proposed = F.when(raw.isNull(), 0).otherwise(F.size(raw))
    accepted = F.when(raw.isNull(), 0).otherwise(F.size(spans))
    return F.struct(F.coalesce(spans, none).alias("spans"), proposed.alias("proposed"), accepted.alias("accepted"), (proposed - accepted).alias("rejected"), raw.isNull().alias("json_failure"))


def parsed_verdicts(reply: Column) -> Column:
    """map<int,string> of a reply's verdicts, the last for each number; null if it cannot be read."""
    raw = json_object(reply, "verdicts array<string>")["verdicts"]
    items = F.transform(raw, lambda x: F.struct(F.get_json_object(x, "$.i").alias("i"), F.get_json_object(x, "$.v").alias("v")))
    # A JSON number may have a fraction, which is cut off.
    numbered = F.transform(items, lambda x: F.struct(F.coalesce(x["i"].try_cast("int"), F.floor(x["i"].try_cast("double")).cast("int")).alias("i"), F.lower(F.trim(x["v"])).alias("v")))
    usable = F.filter(numbered, lambda x: x["i"].isNotNull() & x["v"].isNotNull())
    last = F.filter(F.transform(usable, lambda x, k: F.struct(x.alias("x"), F.exists(F.slice(usable, k + 2, F.size(usable)), lambda o: o["i"] == x["i"]).alias("again"))), lambda x: ~x["again"])
    return F.map_from_entries(F.transform(last, lambda x: x["x"]))


STATS = ("llm_json_failures", "llm_timeouts", "llm_transport_failures", "llm_spans_proposed", "llm_spans_accepted", "llm_spans_rejected")


def _counted(rows: DataFrame, sent: Column, parsed: Column, proposed_before: Column) -> DataFrame:
    """Spans and counters of replies; nothing is taken from calls that failed."""
    answered = sent & F.col("reply_ok") & ~F.col("reply_timed_out")
    pick = lambda name: F.when(answered, parsed[name]).otherwise(0)
    return rows.withColumns({
        "llm_spans": F.when(answered, parsed["spans"]).otherwise(F.array().cast(NO_SPANS)),
        "llm_json_failures": F.when(answered & parsed["json_failure"], 1).otherwise(0),
        "llm_timeouts": F.when(sent & F.col("reply_timed_out"), 1).otherwise(0),
        "llm_transport_failures": F.when(sent & ~F.col("reply_timed_out") & ~F.col("reply_ok"), 1).otherwise(0),
        "llm_spans_proposed": F.when(answered, parsed["proposed"]).otherwise(proposed_before),
        "llm_spans_accepted": pick("accepted"),
        "llm_spans_rejected": pick("rejected"),
        "llm_latency_ms": F.when(sent, F.col("reply_ms")),
    })


def proposed(rows: DataFrame, client: Client, *, text: str = "raw", prompt_profile: str | None = None) -> DataFrame:
    """The rows, llm_spans, the counters of STATS and llm_latency_ms."""
    names = rows.columns
    sent = asked(rows.withColumn("hf_prompt", F.concat(F.lit(span_instructions(prompt_profile)), F.coalesce(F.col(text), F.lit("")))), client, "hf_prompt")
    parsed = once(sent, {"hf_parsed": parsed_spans(F.col("reply_text"), F.coalesce(F.col(text), F.lit("")))})
    return _counted(parsed, F.lit(True), F.col("hf_parsed"), F.lit(0)).select(*names, "llm_spans", *STATS, "llm_latency_ms")


def applied_verdicts(listed: Column, verdicts: Column, triage: bool) -> Column:
    """The candidates that the votes hide, as spans; no vote keeps."""
    voted = F.transform(listed, lambda c, i: F.struct(c.alias("c"), F.coalesce(F.try_element_at(verdicts, i + 1), F.lit("keep")).alias("v")))
    hidden = F.filter(voted, lambda x: x["v"].isin(*(("hide", "unsure") if triage else ("hide",))))
    return F.transform(hidden, lambda x: F.struct(x["c"]["start"].alias("start"), x["c"]["end"].alias("end"), x["c"]["text"].alias("text"), x["c"]["field_type"].alias("field_type"), F.lit("llm").alias("detector"), F.lit(0.9).alias("confidence"), F.concat(F.lit("grader:"), x["v"]).alias("reason")))


def graded(rows: DataFrame, client: Client, policy: Policy, *, text: str = "raw", triage: bool = False) -> DataFrame:
    """As proposed(), by votes on the text's candidates; a text without candidates is not sent."""
    names = rows.columns
    raw = F.coalesce(F.col(text), F.lit(""))
    listed = once(rows, {"hf_listed": candidates(raw, policy)})
    some = F.size("hf_listed") > 0
    sent = asked(listed.withColumn("hf_prompt", F.when(some, vote_prompt(raw, F.col("hf_listed"), triage))), client, "hf_prompt")
    votes = once(sent, {"hf_votes": parsed_verdicts(F.col("reply_text"))})
    hidden = F.coalesce(applied_verdicts(F.col("hf_listed"), F.col("hf_votes"), triage), F.array().cast(NO_SPANS))
    hidden = F.when(F.col("hf_votes").isNull(), F.array().cast(NO_SPANS)).otherwise(hidden)
    parsed = once(votes, {"hf_spans": hidden}).withColumn("hf_parsed", F.struct(F.col("hf_spans").alias("spans"), F.size("hf_listed").alias("proposed"), F.size("hf_spans").alias("accepted"), (F.size("hf_listed") - F.size("hf_spans")).alias("rejected"), F.col("hf_votes").isNull().alias("json_failure")))
    return _counted(parsed, some, F.col("hf_parsed"), F.size("hf_listed")).select(*names, "llm_spans", *STATS, "llm_latency_ms")


def judged(rows: DataFrame, client: Client, *, safe: str = "safe_text", semantics: str = "expected_semantics") -> DataFrame:
    """The rows and judged_ok, judged_score (between 0 and 1), judged_missing, judged_overredaction.

    The judge sees the safe text and the expected semantics, nothing else of a case.
    """
    names = rows.columns
    payload = F.to_json(F.struct(F.col(semantics).alias("expected_semantics"), F.col(safe).alias("safe_text")))
    head = f"You judge how much meaning a blinded text keeps. You see the safe text and the expected semantics only, and you are no safety gate.\nReturn JSON only, in this form:\n{JUDGE_FORM}\n"
    sent = asked(rows.withColumn("hf_prompt", F.concat(F.lit(head), payload)), client, "hf_prompt")
    whole = F.col("reply_text")
    body = F.when(F.get_json_object(whole, "$").startswith("{"), whole).otherwise(F.regexp_extract(whole, r"(?s)\{.*\}", 0))
    sent = sent.withColumn("hf_body", body)
    ok = F.coalesce(F.col("reply_ok") & ~F.col("reply_timed_out") & F.get_json_object("hf_body", "$").startswith("{"), F.lit(False))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.get_json_object("hf_body", "$.semantic_preservation_score").try_cast("double"), F.lit(0.0))))
    missing = F.coalesce(F.json_array_length(F.get_json_object("hf_body", "$.missing_semantics")), F.lit(0))
    over = F.coalesce(F.get_json_object("hf_body", "$.overredaction") == "true", F.lit(False))
    return sent.withColumns({"judged_ok": ok, "judged_score": F.when(ok, score), "judged_missing": F.when(ok, missing).otherwise(0), "judged_overredaction": ok & over}).select(*names, "judged_ok", "judged_score", "judged_missing", "judged_overredaction")
