"""The named queries over the reference operators, and their SQL.

Patterns in the SQL are those in functions.patterns as DuckDB can say them: it has no
lookarounds and its \\b is ASCII's, so where a word must begin or end, the SQL takes in
what stands before or behind it, and gives the group between.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions import patterns as P
from hushframe.functions.normalize import compact
from hushframe.functions.numbers import digit_numbers, ranges
from hushframe.functions.spans import pattern_spans
from hushframe.functions.steps import once
from hushframe.operators import evaluate, proposals, resolve, rewrite, training, verify
from hushframe.operators.detect import candidates, infer_field_type, person_spans
from hushframe.plans import notes as N
from hushframe.plans.blind import blinded
from hushframe.session import scratch, spread
from hushframe.sources.cases import generated_cases
from hushframe.sources.policies import POLICIES, policy_fields
from hushframe.sources.stores import Stores, audit_events

POLICY = POLICIES["client_strategy"]
FLAGSHIP = "blind_notes"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What is no letter, mark, digit or underscore of any alphabet, or an end of the text; and a white space of any kind.
_EDGE = r"(?:^|[^\p{L}\p{M}\p{N}_])"
_EDGE_AFTER = r"(?:$|[^\p{L}\p{M}\p{N}_])"


def exploded(rows: DataFrame, key: str, spans: Column) -> DataFrame:
    return once(rows, {"hf_spans": spans}).select(key, F.posexplode("hf_spans").alias("n", "s")).select(key, "n", "s.text", "s.start", "s.end")


def _spans_query(name: str, source: str, key: str, column: str, kind: str, pattern: str, reason: str, confidence: float, sql_pattern: str, options: str = "", group: int = 0) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = {"notes": N.notes, "planted": N.planted}.get(source, lambda s, d: table(s, d, source))(spark, sf_dir)
        return exploded(rows.select(key, column), key, pattern_spans(F.col(column), pattern, kind, reason, confidence)).select(key, "n", "text")

    run.__name__ = name
    head = {"notes": f"WITH {N.NOTES}, ", "planted": f"WITH {N.PLANTED_NOTES}, "}.get(source, "WITH ")
    found = f"regexp_extract_all({column}, '{sql_pattern.replace(chr(39), chr(39) * 2)}', {group}{', ' + chr(39) + options + chr(39) if options else ''})"
    query(f"{head}m AS (SELECT {key}, {found} AS hits FROM {source}) SELECT {key}, CAST(unnest(generate_series(1, len(hits))) - 1 AS INTEGER) AS n, unnest(hits) AS text FROM m")(run)


def plain(pattern: str) -> str:
    """A pattern without its flags."""
    return pattern[pattern.index(")") + 1 :]


_B = r"\b"
_LOOK = re.compile(r"\(\?<?!(?:\\w|\[[^\]]*\])\)")
_DETECTOR = {(kind, reason): (pattern, confidence) for kind, pattern, reason, confidence in P.DETECTORS}
for _name, _source, _key, _column, _kind, _reason, _options in (
    ("span_email", "documents", "doc_id", "text", "email", "email address", ""),
    ("span_secret", "documents", "doc_id", "text", "secret_token", "long token-like string", ""),
    ("span_account", "documents", "doc_id", "text", "account_id", "account id", "i"),
    ("span_url", "pages", "page_id", "url", "url", "url or domain", ""),
    ("span_api_key", "planted", "note_id", "raw", "api_key", "api-key-like secret", "i"),
    ("span_labeled_key", "planted", "note_id", "raw", "api_key", "labeled api-key-like secret", "i"),
    ("span_labeled_secret", "planted", "note_id", "raw", "secret_token", "labeled secret token", "i"),
    ("span_date", "notes", "note_id", "raw", "date", "date", "i"),
    ("span_relative_date", "planted", "note_id", "raw", "date", "relative date phrase", "i"),
    ("span_price", "notes", "note_id", "raw", "budget", "price or budget", "i"),
    ("span_spelled_price", "planted", "note_id", "raw", "budget", "spelled price or budget", "i"),
    ("span_business", "notes", "note_id", "raw", "business_name", "organization suffix heuristic", ""),
    ("span_model", "notes", "note_id", "raw", "model_name", "known model name", "i"),
    ("span_model_context", "planted", "note_id", "raw", "model_name", "model or source identity phrase", "i"),
    ("span_sentinel", "planted", "note_id", "raw", "secret_token", "debug or reveal sentinel", "i"),
    ("span_status", "notes", "note_id", "raw", "client_status", "private client status phrase", "i"),
    ("span_status_idiom", "notes", "note_id", "raw", "client_status", "generalizing client status idiom", "i"),
    ("span_relation_role", "planted", "note_id", "raw", "business_relationship", "role-only relationship reference", "i"),
    ("span_relation_one", "planted", "note_id", "raw", "business_relationship", "indirect 'the one who' relationship reference", "i"),
    ("span_relation_whoever", "planted", "note_id", "raw", "business_relationship", "indirect 'whoever' relationship reference", "i"),
):
    _pattern, _confidence = _DETECTOR[_kind, _reason]
    _sql = plain(_pattern)
    # Documents are of any alphabet: a word's first letter must not stand behind another letter of any.
    _wide = _source == "documents"
    _spans_query(_name, _source, _key, _column, _kind, _pattern, _reason, _confidence, f"{_EDGE}({_sql.removeprefix(_B)})" if _wide else _sql, _options, int(_wide))

for _name, _source, _key, _column, _kind, _reason, _front, _body, _back in (
    ("span_phone", "documents", "doc_id", "text", "phone", "phone number", _EDGE, P.PHONE, _EDGE_AFTER),
    ("span_local_phone", "documents", "doc_id", "text", "phone", "local phone number", r"(?:^|[^\p{L}\p{M}\p{N}_.-])", P.LOCAL_PHONE, r"(?:$|[^\p{L}\p{M}\p{N}_.-])"),
    ("span_file_path", "documents", "doc_id", "text", "file_path", "local file path", _EDGE, P.FILE_PATH, ""),
    ("span_planted_phone", "planted", "note_id", "raw", "phone", "phone number", _EDGE, P.PHONE, _EDGE_AFTER),
    ("span_planted_local_phone", "planted", "note_id", "raw", "phone", "local phone number", r"(?:^|[^\p{L}\p{M}\p{N}_.-])", P.LOCAL_PHONE, r"(?:$|[^\p{L}\p{M}\p{N}_.-])"),
    ("span_planted_path", "planted", "note_id", "raw", "file_path", "local file path", _EDGE, P.FILE_PATH, ""),
):
    _pattern, _confidence = _DETECTOR[_kind, _reason]
    # Without the lookarounds at either end.
    _inner = _LOOK.sub("", plain(_body))
    _spans_query(_name, _source, _key, _column, _kind, _pattern, _reason, _confidence, f"{_front}({_inner}){_back}", "", 1)


@query(f"""WITH {N.PLANTED_NOTES}, m AS (SELECT note_id, regexp_extract_all(raw, '\\b(?:Dr|Mr|Mrs|Ms|Prof|Sir|Capt|Sgt|Rev)\\.?\\s+[A-Z][a-z]{{2,}}(?:\\s+[A-Z][a-z]{{2,}})?') || regexp_extract_all(raw, '\\b[A-Z]\\.\\s*[A-Z][a-z]{{2,}}\\b') || regexp_extract_all(raw, '(\\b[A-Z][a-z]{{2,}}\\s+[A-Z]\\.)(?:$|[^A-Za-z0-9_])', 1) AS hits FROM planted)
SELECT note_id, text, count(*) AS n FROM (SELECT note_id, unnest(hits) AS text FROM m) GROUP BY ALL""")
def span_titles(spark, sf_dir):
    """Names with a title or an initial."""
    forms = person_spans(F.col("raw"))[1:]
    return exploded(N.planted(spark, sf_dir), "note_id", F.concat(*forms)).groupBy("note_id", "text").agg(F.count("*").alias("n"))


@query(f"""WITH {N.NOTES}, p AS (SELECT note_id, CASE WHEN position('$' IN raw) > 0 THEN position('$' IN raw) - 1 END AS s, regexp_extract(raw, '\\$[0-9]+/day') AS t FROM notes)
SELECT note_id, CAST(s AS INTEGER) AS "start", CAST(s + length(t) AS INTEGER) AS "end", t AS text FROM p""")
def span_offsets(spark, sf_dir):
    """Places count code points and give the text back."""
    rows = exploded(N.notes(spark, sf_dir).select("note_id", "raw"), "note_id", pattern_spans(F.col("raw"), P.PRICE, "budget", "price or budget", 0.92))
    return rows.select("note_id", "start", "end", "text")


@query(f"""WITH {N.NOTES}, v AS (SELECT note_id, unnest([person, org, city, email, account, day, model, '$' || budget || '/day', status]) AS value FROM notes)
SELECT note_id, value, CASE WHEN value LIKE '%@%' THEN 'email' WHEN value LIKE '$%' THEN 'budget' WHEN starts_with(value, 'acct_') THEN 'account_id' WHEN regexp_full_match(value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'date'
WHEN regexp_matches(value, '(Roofing|Dental|Insurance|Services|Clinic|Media)$') THEN 'business_name' WHEN value IN ({", ".join(f"'{x}'" for x in P.LOCATIONS)}) THEN 'location' WHEN value IN ({", ".join(f"'{x}'" for x in P.STATUS_PHRASES)}) THEN 'client_status'
WHEN regexp_full_match(value, '[A-Z][a-z]{{2,}} [A-Z][a-z]{{2,}}') THEN 'person_name' WHEN value IN ('Claude', 'Gemini', 'Qwen', 'Llama') THEN 'model_name' ELSE 'private_note' END AS kind FROM v""")
def infer_type(spark, sf_dir):
    values = F.explode(F.array("person", "org", "city", "email", "account", "day", "model", F.concat(F.lit("$"), F.col("budget"), F.lit("/day")), "status"))
    return N.notes(spark, sf_dir).select("note_id", values.alias("value")).withColumn("kind", infer_field_type(F.col("value")))


@query(f"""WITH {N.NOTES}, m AS (SELECT note_id, regexp_extract_all(raw, '\\b([A-Z][a-z]{{2,}}\\s+[A-Z][a-z]{{2,}})\\b', 1) AS hits FROM notes), e AS (SELECT note_id, unnest(hits) AS text FROM m)
SELECT note_id, text, count(*) AS n FROM e WHERE NOT regexp_matches(text, '{plain(P.BUSINESS)}') AND text NOT IN ({", ".join(f"'{x}'" for x in P.NOT_PERSONS)}) GROUP BY ALL""")
def person_filtered(spark, sf_dir):
    pairs = person_spans(F.col("raw"))[0]
    return exploded(N.notes(spark, sf_dir).select("note_id", "raw"), "note_id", pairs).groupBy("note_id", "text").agg(F.count("*").alias("n"))


@query(f"WITH {N.NOTES}, v AS (SELECT note_id, raw, unnest([person, org, city]) AS value FROM notes) SELECT note_id, value, CAST((length(lower(raw)) - length(replace(lower(raw), lower(value), ''))) / length(value) AS INTEGER) AS n FROM v")
def canary_hits(spark, sf_dir):
    from hushframe.functions.spans import literal_column, places

    rows = N.notes(spark, sf_dir).select("note_id", "raw", F.explode(F.array("person", "org", "city")).alias("value"))
    return rows.select("note_id", "value", F.size(places(F.col("raw"), literal_column(F.col("value")))).alias("n"))


@query()
def candidate_top14(spark, sf_dir):
    return exploded(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", candidates(F.col("text"), POLICY))


# A table of spans with ties, touches and overlaps, from lineitem, for the relational forms.
_SPANS = "SELECT l_orderkey AS note_id, CAST(l_partkey % 40 AS INTEGER) AS \"start\", CAST(l_partkey % 40 + l_suppkey % 9 AS INTEGER) AS \"end\", l_linenumber AS seq, {kind} AS field_type, {detector} AS detector, CAST(l_linenumber % 3 AS DOUBLE) / 4 AS confidence FROM {lineitem}"
_KINDS = ("email", "person_name", "budget", "location", "unknown_kind")
_WHO = ("regex", "heuristic", "llm", "fixture")


def _case(column: str, some: tuple[str, ...]) -> str:
    return f"CASE {column} % {len(some)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(some)) + " END"


SPANS = "spans AS (" + _SPANS.format(kind=_case("l_suppkey", _KINDS), detector=_case("l_partkey", _WHO), lineitem="lineitem") + ")"


def span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of lineitem as spans; of an order's equal line numbers, the winners' last names decide."""
    lines = table(spark, sf_dir, "lineitem")
    sql = _SPANS.replace('"', "`").format(kind=_case("l_suppkey", _KINDS), detector=_case("l_partkey", _WHO), lineitem="{lineitem}")
    return spark.sql(sql, lineitem=lines)


_THRESHOLD = "".join(f", ('{k}', {0.25 if k == 'budget' else 0.0})" for k in P.FIELD_TYPES)[2:]


@query(f"WITH {SPANS} SELECT s.* FROM spans s JOIN (VALUES {_THRESHOLD}) p(field_type, least) USING (field_type) WHERE confidence >= least")
def policy_threshold(spark, sf_dir):
    """The threshold as a join: the policy is a dimension of a row a kind, small enough to send to every task."""
    fields = policy_fields(spark, POLICY).select("field_type", F.when(F.col("field_type") == "budget", 0.25).otherwise(0.0).alias("least"))
    return span_rows(spark, sf_dir).join(F.broadcast(fields), "field_type").where("confidence >= least").select("note_id", "start", "end", "seq", "field_type", "detector", "confidence")


ISLANDS = f"""{SPANS}, reach AS (SELECT *, max("end") OVER (PARTITION BY note_id ORDER BY "start", "end", seq, field_type DESC, detector DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans WHERE "start" < "end"),
islands AS (SELECT * EXCLUDE r, CAST(sum(CASE WHEN "start" < r THEN 0 ELSE 1 END) OVER (PARTITION BY note_id ORDER BY "start", "end", seq, field_type DESC, detector DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM reach)"""


@query(f"WITH {ISLANDS} SELECT * FROM islands")
def span_islands(spark, sf_dir):
    return resolve.islands_by_window(span_rows(spark, sf_dir), "note_id")


_RANK = "CASE field_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.SENSITIVITY.items()) + " ELSE 0 END"


@query(f"""WITH {ISLANDS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY note_id, island ORDER BY confidence DESC, "end" - "start" DESC, {_RANK} DESC, "start", "end", seq, field_type DESC, detector DESC) AS k, min("start") OVER (PARTITION BY note_id, island) AS a, max("end") OVER (PARTITION BY note_id, island) AS b FROM islands)
SELECT note_id, island, a AS "start", b AS "end", field_type, detector, confidence FROM ranked WHERE k = 1""")
def island_winner(spark, sf_dir):
    return resolve.winners(resolve.islands_by_window(span_rows(spark, sf_dir), "note_id"), "note_id").drop("sources", "n_spans")


@query(f"WITH {ISLANDS} SELECT note_id, island, array_to_string(list_sort(list_distinct(list(CASE WHEN detector IN ('fixture', 'llm') THEN detector ELSE 'detector' END))), ',') AS sources, count(*) AS n_spans FROM islands GROUP BY 1, 2")
def island_sources(spark, sf_dir):
    rows = resolve.winners(resolve.islands_by_window(span_rows(spark, sf_dir), "note_id"), "note_id")
    return rows.select("note_id", "island", F.array_join("sources", ",").alias("sources"), "n_spans")


def _row_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same spans as arrays, resolved within rows; of equal seq, the last names are listed first, as winners() has it."""
    item = F.struct("start", "end", F.lit("").alias("text"), "field_type", "detector", "confidence", F.lit("").alias("reason"))
    rows = span_rows(spark, sf_dir).groupBy("note_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct((-F.col("seq")).alias("seq"), item.alias("s"))))).alias("listed"))
    spans = once(rows, {"spans": F.transform("listed", lambda x: x["s"])})
    return once(spans, {"clusters": resolve.clusters(F.col("spans"), F.lit(""))})


@query(f"""WITH {ISLANDS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY note_id, island ORDER BY confidence DESC, "end" - "start" DESC, {_RANK} DESC, "start", "end", seq, field_type DESC, detector DESC) AS k, min("start") OVER (PARTITION BY note_id, island) AS a, max("end") OVER (PARTITION BY note_id, island) AS b FROM islands)
SELECT note_id, a AS "start", b AS "end", field_type, detector FROM ranked WHERE k = 1""")
def clusters_in_row(spark, sf_dir):
    return _row_clusters(spark, sf_dir).select("note_id", F.inline("clusters")).select("note_id", "start", "end", "field_type", "detector")


@query(f"""WITH {ISLANDS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY note_id, island ORDER BY confidence DESC, "end" - "start" DESC, {_RANK} DESC, "start", "end", seq, field_type DESC, detector DESC) AS k, CASE WHEN detector IN ('fixture', 'llm') THEN detector ELSE 'detector' END AS src FROM islands),
c AS (SELECT note_id, island, max(CASE WHEN k = 1 THEN src END) AS src, count(DISTINCT src) AS n, bool_or(src = 'llm') AS llm FROM ranked GROUP BY 1, 2)
SELECT note_id, CAST(count(*) FILTER (src = 'fixture') AS INTEGER) AS by_fixture, CAST(count(*) FILTER (src = 'detector') AS INTEGER) AS by_detector, CAST(count(*) FILTER (src = 'llm') AS INTEGER) AS by_llm, CAST(count(*) FILTER (n > 1) AS INTEGER) AS combined, CAST(count(*) FILTER (llm) AS INTEGER) AS llm_touched FROM c GROUP BY 1""")
def attribution_counts(spark, sf_dir):
    rows = once(_row_clusters(spark, sf_dir).where("size(clusters) > 0"), {"a": resolve.attribution(F.col("clusters"))})
    return rows.select("note_id", F.col("a.removed_by_fixture_canary").alias("by_fixture"), F.col("a.removed_by_detector").alias("by_detector"), F.col("a.removed_by_llm").alias("by_llm"), F.col("a.removed_by_combined").alias("combined"), F.col("a.llm_unique_spans_accepted").alias("llm_touched"))


def _changed(spark: SparkSession, sf_dir: str, pattern: str, kind: str) -> DataFrame:
    """Notes with the changes that one detector's spans lead to."""
    rows = once(N.notes(spark, sf_dir), {"spans": pattern_spans(F.col("raw"), pattern, kind, "", 0.9)})
    rows = once(rows, {"clusters": resolve.clusters(F.col("spans"), F.col("raw"))})
    return once(rows, {"changes": rewrite.replacements(F.col("clusters"), POLICY, 2026)})


@query(f"WITH {N.NOTES} SELECT note_id, regexp_replace(raw, '{plain(P.EMAIL)}', '[REDACTED_EMAIL]', 'g') AS safe FROM notes")
def rewrite_redact(spark, sf_dir):
    rows = once(N.notes(spark, sf_dir), {"spans": pattern_spans(F.col("raw"), P.EMAIL, "email", "", 0.9)})
    rows = once(rows, {"clusters": resolve.clusters(F.col("spans"), F.col("raw"))})
    rows = once(rows, {"changes": rewrite.replacements(F.col("clusters"), POLICIES["hard_egress"], 2026)})
    return rows.select("note_id", rewrite.spliced(F.col("raw"), F.col("changes")).alias("safe"))


@query(f"WITH {N.NOTES} SELECT note_id, replace(raw, model, 'Model_1') AS safe FROM notes")
def rewrite_splice(spark, sf_dir):
    return _changed(spark, sf_dir, P.MODEL, "model_name").select("note_id", rewrite.spliced(F.col("raw"), F.col("changes")).alias("safe"))


@query(f"""WITH {N.NOTES}, h AS (SELECT note_id, regexp_extract_all(raw, '\\b[A-Z][a-z]{{2,}}\\b') AS hits FROM notes), e AS (SELECT note_id, unnest(hits) AS t, unnest(generate_series(1, len(hits))) AS i FROM h),
d AS (SELECT note_id, t, max(i) AS i FROM e GROUP BY 1, 2) SELECT note_id, t AS original, 'Person_' || CAST(row_number() OVER (PARTITION BY note_id ORDER BY i DESC) AS VARCHAR) AS placeholder, sha256(t) AS sha FROM d""")
def pseudonym_numbers(spark, sf_dir):
    """Numbers from the end: the last distinct original is 1."""
    rows = _changed(spark, sf_dir, r"\b[A-Z][a-z]{2,}\b", "person_name")
    return rows.select("note_id", F.inline(rewrite.reveal_entries(F.col("changes")))).select("note_id", F.col("original_value").alias("original"), "placeholder", F.col("original_sha256").alias("sha"))


@query(f"WITH {N.NOTES} SELECT note_id, model, sha256(model) AS sha, 'Model_1' AS placeholder FROM notes")
def reveal_map(spark, sf_dir):
    rows = _changed(spark, sf_dir, P.MODEL, "model_name")
    return rows.select("note_id", F.inline(rewrite.reveal_entries(F.col("changes")))).select("note_id", F.col("original_value").alias("model"), F.col("original_sha256").alias("sha"), "placeholder")


@query("""WITH v AS (SELECT o_orderkey, CAST(CAST(floor(o_totalprice / 100) AS BIGINT) AS VARCHAR) AS n, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN '$' || n || '/day' WHEN 1 THEN '$' || n || '/month' WHEN 2 THEN n || '% commission' ELSE 'no number' END AS value,
CASE k WHEN 2 THEN 'a private commission arrangement' WHEN 3 THEN 'a business budget amount' WHEN 1 THEN CASE WHEN n::INT < 500 THEN 'a small monthly budget' WHEN n::INT <= 1500 THEN 'a modest monthly budget' ELSE 'a significant monthly budget' END
ELSE CASE WHEN n::INT < 50 THEN 'a small daily budget' WHEN n::INT <= 150 THEN 'a modest daily budget' WHEN n::INT <= 500 THEN 'a significant daily budget' ELSE 'a business budget amount' END END AS safe FROM v""")
def generalize_budget(spark, sf_dir):
    n, k = F.floor(F.col("o_totalprice") / 100).cast("string"), F.col("o_orderkey") % 4
    value = F.when(k == 0, F.concat(F.lit("$"), n, F.lit("/day"))).when(k == 1, F.concat(F.lit("$"), n, F.lit("/month"))).when(k == 2, F.concat(n, F.lit("% commission"))).otherwise("no number")
    rows = once(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), {"value": value})
    return rows.select("o_orderkey", "value", rewrite.generalized_budget(F.col("value")).alias("safe"))


@query(f"WITH {N.NOTES} SELECT note_id, CASE WHEN note_id % 7 = 0 THEN 'deadline ' || day ELSE day END AS value, CASE WHEN note_id % 7 = 0 THEN 'a deadline' WHEN CAST(substr(day, 1, 4) AS INT) > 2026 THEN 'a future date' ELSE 'a recent date' END AS safe FROM notes")
def generalize_date(spark, sf_dir):
    value = F.when(F.col("note_id") % 7 == 0, F.concat(F.lit("deadline "), F.col("day"))).otherwise(F.col("day"))
    return N.notes(spark, sf_dir).select("note_id", value.alias("value")).withColumn("safe", rewrite.generalized(F.lit("date"), F.col("value"), 2026))


@query(f"WITH {N.NOTES} SELECT note_id, replace(replace('Person_1 met Org_1 and Person_10', 'Org_1', org), 'Person_1', person) AS text FROM notes")
def unblind(spark, sf_dir):
    """Placeholders turn back one after another, also inside longer ones."""
    entry = lambda kind, shown, original: F.struct(F.lit(kind).alias("field_type"), F.col(original).alias("original_value"), F.lit("").alias("original_sha256"), F.lit(shown).alias("placeholder"))
    entries = F.array(entry("business_name", "Org_1", "org"), entry("person_name", "Person_1", "person"))
    return N.notes(spark, sf_dir).select("note_id", rewrite.revealed(F.lit("Person_1 met Org_1 and Person_10"), entries).alias("text"))


# Leaks: each note's values against the next customer's text, with edits that only one check finds.
def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.notes(spark, sf_dir)
    return rows.select("note_id", "person", "org", "budget", F.when(F.col("note_id") % 3 == 0, F.concat(F.lit("about "), F.lower("org"))).when(F.col("note_id") % 3 == 1, F.concat(F.lit("about "), F.replace(F.lower("org"), F.lit(" "), F.lit("-")))).otherwise("about nothing").alias("safe"))


PAIRS = f"{N.NOTES}, pairs AS (SELECT note_id, person, org, budget, CASE note_id % 3 WHEN 0 THEN 'about ' || lower(org) WHEN 1 THEN 'about ' || replace(lower(org), ' ', '-') ELSE 'about nothing' END AS safe FROM notes)"


@query(f"WITH {PAIRS} SELECT note_id, contains(safe, lower(org)) AS leak FROM pairs")
def leak_exact(spark, sf_dir):
    return _pairs(spark, sf_dir).select("note_id", verify.exact_leak(F.lower("org"), F.col("safe")).alias("leak"))


@query(f"WITH {PAIRS} SELECT note_id, contains(regexp_replace(translate(safe, '013457', 'oieast'), '[^A-Za-z0-9]', '', 'g'), regexp_replace(translate(lower(org), '013457', 'oieast'), '[^A-Za-z0-9]', '', 'g')) AS leak FROM pairs")
def leak_compact(spark, sf_dir):
    return _pairs(spark, sf_dir).select("note_id", verify.compact_leak(compact(F.lower("org")), compact(F.col("safe"))).alias("leak"))


_STOP = ", ".join(f"'{x}'" for x in P.GENERIC_WORDS)


@query(f"WITH {PAIRS}, w AS (SELECT note_id, safe, unnest(regexp_extract_all(lower(org), '[a-z0-9]+')) AS piece FROM pairs) SELECT note_id, bool_or(length(piece) >= 4 AND piece NOT IN ({_STOP}) AND contains(safe, piece)) AS leak FROM w GROUP BY 1")
def leak_piece(spark, sf_dir):
    rows = once(_pairs(spark, sf_dir), {"pieces": verify.meaningful(F.lower("org")), "tight": compact(F.col("safe"))})
    return rows.select("note_id", verify.piece_leak(F.col("pieces"), F.col("safe"), F.col("tight")).alias("leak"))


@query(f"""WITH {PAIRS}, p AS (SELECT note_id, unnest(regexp_extract_all(lower(person), '[a-z0-9]+')) AS piece, CASE note_id % 2 WHEN 0 THEN 'met ' || substr(lower(person), 2) ELSE 'met ' || lower(person) END AS safe FROM pairs),
w AS (SELECT note_id, piece, unnest(regexp_extract_all(safe, '[a-z0-9]+')) AS word FROM p) SELECT note_id, bool_or(length(piece) BETWEEN 4 AND 20 AND piece NOT IN ({_STOP}) AND length(word) BETWEEN 3 AND 20 AND word NOT IN ({_STOP}) AND levenshtein(piece, word) = 1) AS leak FROM w GROUP BY 1""")
def leak_near(spark, sf_dir):
    safe = F.when(F.col("note_id") % 2 == 0, F.concat(F.lit("met "), F.substr(F.lower("person"), F.lit(2)))).otherwise(F.concat(F.lit("met "), F.lower("person")))
    rows = once(_pairs(spark, sf_dir), {"pieces": verify.meaningful(F.lower("person")), "safe_words": verify.near_words(safe)})
    return rows.select("note_id", verify.near_leak(F.col("pieces"), F.col("safe_words")).alias("leak"))


@query(f"WITH {PAIRS} SELECT note_id, CAST(budget AS INT) = note_id % 100 OR CAST(budget AS INT) BETWEEN 1000 AND 2000 AS leak FROM pairs")
def leak_numeric(spark, sf_dir):
    """A number again, or inside a range."""
    safe = F.concat(F.lit("from 1000 to 2000, or "), (F.col("note_id") % 100).cast("string"), F.lit("."))
    rows = once(_pairs(spark, sf_dir), {"mine": digit_numbers(F.col("budget")), "theirs": digit_numbers(safe), "between": ranges(safe)})
    return rows.select("note_id", verify.numeric_leak(F.col("mine"), F.filter("theirs", lambda x: ~x.isin(1000.0, 2000.0)), F.col("between")).alias("leak"))


@query(f"WITH {SPANS} SELECT note_id FROM (SELECT note_id, field_type, detector FROM spans GROUP BY ALL HAVING count(DISTINCT \"start\") > 1 UNION ALL SELECT note_id, field_type, NULL FROM spans GROUP BY note_id, field_type, \"start\" HAVING count(DISTINCT detector) > 1) GROUP BY 1")
def coreference_conflict(spark, sf_dir):
    entries = span_rows(spark, sf_dir).select("note_id", "field_type", F.col("detector").alias("original_sha256"), F.col("start").cast("string").alias("placeholder"))
    return verify.mapping_conflicts(entries, "note_id")


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).select("note_id", F.col("safe").alias("safe_text"), F.array("org").alias("canaries"), F.array(F.lit("business_relationship")).alias("canary_types"))
    return verify.verified(rows, entries=None, ascii_only=True)


@query(f"WITH {PAIRS} SELECT note_id, CASE WHEN note_id % 3 = 0 THEN 'passed=False; hard=1; near=0; numeric=0; reveal_map=0; coreference=0; warnings=0' ELSE 'passed=True; hard=0; near=0; numeric=0; reveal_map=0; coreference=0; warnings=0' END AS summary FROM pairs")
def verify_summary(spark, sf_dir):
    return _verified(spark, sf_dir).select("note_id", verify.summary(F.col("verification")).alias("summary"))


@query(f"WITH {PAIRS} SELECT note_id, CASE WHEN note_id % 3 = 0 THEN 1 ELSE 0 END AS hard_leak_count, note_id % 3 <> 0 AS verification_passed FROM pairs")
def audit_counts(spark, sf_dir):
    rows = _verified(spark, sf_dir).withColumns({"artifact_id": F.col("note_id").cast("string"), "verification_summary": verify.summary(F.col("verification")), "verification_status": F.when(F.col("verification.passed"), "passed").otherwise("failed")})
    events = audit_events(rows.drop("verification"), "eval_case", "2026-01-01T00:00:00+00:00", "client_strategy")
    return events.select(F.col("artifact_id").cast("long").alias("note_id"), "hard_leak_count", "verification_passed")


# Replies: one a note, some of them broken.
_REPLY = """CASE WHEN note_id % 5 = 4 THEN 'not json' ELSE concat('so: {"verdicts":[{"i":1,"v":"', CASE WHEN note_id % 2 = 0 THEN 'Hide ' ELSE 'keep' END, '"},{"i":"2","v":"unsure"},{"i":3,"v":7}]}') END"""


@query(f"WITH {N.NOTES} SELECT note_id, CASE WHEN note_id % 5 = 4 THEN NULL WHEN note_id % 2 = 0 THEN 'hide' ELSE 'keep' END AS first, CASE WHEN note_id % 5 = 4 THEN NULL ELSE 'unsure' END AS second FROM notes")
def verdict_parse(spark, sf_dir):
    rows = once(N.notes(spark, sf_dir).selectExpr("note_id", f"{_REPLY} AS reply"), {"votes": proposals.parsed_verdicts(F.col("reply"))})
    return rows.select("note_id", F.try_element_at("votes", F.lit(1)).alias("first"), F.try_element_at("votes", F.lit(2)).alias("second"))


@query(f"WITH {N.NOTES} SELECT note_id, CAST(CASE WHEN note_id % 5 = 4 THEN 0 WHEN note_id % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS triage, CAST(CASE WHEN note_id % 5 = 4 THEN 0 WHEN note_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS binary FROM notes")
def verdict_apply(spark, sf_dir):
    """Three candidates a note; a missing vote keeps, unsure hides in triage only."""
    item = lambda i: F.struct(F.lit(i).alias("start"), F.lit(i + 1).alias("end"), F.lit("x").alias("text"), F.lit("private_note").alias("field_type"))
    rows = once(N.notes(spark, sf_dir).selectExpr("note_id", f"{_REPLY} AS reply"), {"votes": proposals.parsed_verdicts(F.col("reply")), "listed": F.array(*map(item, range(3)))})
    count = lambda triage: F.coalesce(F.size(F.when(F.col("votes").isNotNull(), proposals.applied_verdicts(F.col("listed"), F.col("votes"), triage))), F.lit(0))
    return rows.select("note_id", F.greatest(count(True), F.lit(0)).alias("triage"), F.greatest(count(False), F.lit(0)).alias("binary"))


@query(f"WITH {N.NOTES} SELECT note_id, CAST(1 AS INTEGER) AS accepted, CAST(2 AS INTEGER) AS rejected, CAST(position(org IN raw) - 1 AS INTEGER) AS \"start\", 1.0::DOUBLE AS confidence FROM notes")
def proposal_parse(spark, sf_dir):
    """One good span with too high a confidence, one that is not in the text, one of no known kind."""
    reply = F.concat(F.lit('{"spans":[{"text":"'), F.col("org"), F.lit('","field_type":"business_name","confidence":1.7},{"text":"not there","field_type":"date"},{"text":"Budget","field_type":"colour"}]}'))
    rows = once(N.notes(spark, sf_dir), {"p": proposals.parsed_spans(reply, F.col("raw"))})
    return rows.select("note_id", "p.accepted", "p.rejected", F.get("p.spans", F.lit(0))["start"].alias("start"), F.get("p.spans", F.lit(0))["confidence"].alias("confidence"))


# Suites: results a case, from orders, with two lanes.
_RESULTS = "SELECT o_orderkey AS line_no, o_orderkey % 4 <> 0 AS passed, o_orderkey % 5 <> 0 AS det_passed, CAST(o_orderkey % 3 AS INT) AS hard, floor(o_totalprice) AS latency, o_orderkey % 97 = 50 AS failed FROM {orders}"
RESULTS = f"results AS ({_RESULTS.format(orders='orders')})"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_RESULTS, orders=table(spark, sf_dir, "orders")).withColumn("latency", F.col("latency").cast("double"))


def as_evaluated(rows: DataFrame) -> DataFrame:
    """Such results in the form that totals() reads."""
    none = F.array().cast("array<string>")
    verdict = F.struct(F.col("passed"), F.col("hard").alias("hard_leaks"), *(F.lit(0).alias(x) for x in ("near_leaks", "numeric_leaks", "reveal_map_leaks", "coreference_errors")), none.alias("warnings"))
    counted = F.struct(*(F.lit(1).alias(x) for x in evaluate.REMOVED), none.alias("llm_unique_span_field_types"))
    return rows.withColumns({"verification": verdict, "attribution": counted, "safe_text": F.lit("new"), "raw": F.lit("raw text"), "det_safe_text": F.when(F.col("line_no") % 2 == 0, "old").otherwise("new"), "llm_latency_ms": F.col("latency"), "latency_ms": F.col("latency"), "process_failed": F.lit(False), "fixture_passed": F.col("line_no") % 8 != 0} | {x: F.lit(0) for x in proposals.STATS})


@query(f"WITH {RESULTS} SELECT count(*) AS cases_total, count(*) FILTER (passed) AS cases_passed, CAST(sum(hard) AS BIGINT) AS hard_leaks, count(*) AS removed_by_detector, 3.0::DOUBLE AS avg_safe_chars FROM results")
def eval_totals(spark, sf_dir):
    return evaluate.totals(as_evaluated(results(spark, sf_dir))).select("cases_total", "cases_passed", "hard_leaks", "removed_by_detector", "avg_safe_chars")


@query(f"WITH {RESULTS} SELECT count(*) FILTER (line_no % 2 = 0) AS changed, count(*) FILTER (line_no % 2 = 0 AND NOT det_passed AND passed) AS prevented, count(*) FILTER (line_no % 2 = 0 AND det_passed AND NOT passed) AS caused, count(*) FILTER (NOT passed AND line_no % 8 <> 0) AS saved FROM results")
def eval_lane_delta(spark, sf_dir):
    out = evaluate.totals(as_evaluated(results(spark, sf_dir)))
    return out.select(F.col("cases_where_llm_changed_output").alias("changed"), F.col("cases_where_llm_prevented_failure").alias("prevented"), F.col("cases_where_llm_caused_failure").alias("caused"), F.col("cases_where_fixture_would_have_saved").alias("saved"))


@query("WITH s AS (SELECT o_custkey, list_sort(list(floor(o_totalprice))) AS v FROM orders GROUP BY 1) SELECT o_custkey, v[CAST(round_even((len(v) - 1) * 0.5, 0) AS INT) + 1] AS p50, v[CAST(round_even((len(v) - 1) * 0.95, 0) AS INT) + 1] AS p95 FROM s")
def eval_percentiles(spark, sf_dir):
    values = F.array_sort(F.collect_list(F.floor("o_totalprice").cast("double"))).alias("v")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(values).select("o_custkey", evaluate.nearest_rank(F.col("v"), 50).alias("p50"), evaluate.nearest_rank(F.col("v"), 95).alias("p95"))


@query(f"WITH {RESULTS} SELECT line_no FROM (SELECT line_no, row_number() OVER (ORDER BY line_no) AS n FROM results WHERE passed) WHERE n <= 25")
def first_n(spark, sf_dir):
    """The first 25 cases that passed; a limit is the feature here."""
    return evaluate.first_cases(results(spark, sf_dir), 25, F.col("passed")).select("line_no")


@query(f"WITH {RESULTS} SELECT line_no, coalesce(line_no > (SELECT min(line_no) FROM results WHERE failed), false) AS disabled FROM results")
def breaker_mask(spark, sf_dir):
    return evaluate.breaker(results(spark, sf_dir), F.col("failed")).select("line_no", "disabled")


def stored(spark: SparkSession, sf_dir: str, judged: bool = False) -> Stores:
    """Stores with an artifact for each customer, saved on three days; a quarter failed, and a tenth is deleted again."""
    store = Stores(spark, scratch(spark, "stores"))
    entry = lambda kind, original, shown: F.struct(F.lit(kind).alias("field_type"), F.col(original).alias("original_value"), F.sha2(original, 256).alias("original_sha256"), F.lit(shown).alias("placeholder"))
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("artifact_id"),
        (F.col("c_custkey") % 3).alias("day"),
        F.lit("Person_1").alias("safe_text"),
        F.struct((F.col("c_custkey") % 4 != 0).alias("passed")).alias("verification"),
        F.when(F.col("c_custkey") % 4 != 0, "passed").otherwise("failed").alias("verification_status"),
        F.when(F.col("c_custkey") % 2 == 0, F.array(entry("person_name", "c_name", "Person_1"), entry("business_name", "c_mktsegment", "Org_1"))).otherwise(F.array(entry("person_name", "c_name", "Person_1"))).alias("reveal_entries"),
        (F.col("c_custkey") % 10 == 0).alias("gone"),
    )
    for day in range(3):
        store.save(rows.where(F.col("day") == day), f"2026-01-0{day + 1}T00:00:00+00:00")
    store.delete(rows.where("gone"), "2026-01-09T00:00:00+00:00")
    if judged:
        store.submit_judgments(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("judgment_id"), F.col("o_custkey").cast("string").alias("artifact_id"), F.col("o_orderpriority").alias("judgment_text")), "2026-01-10T00:00:00+00:00")
    return store


_GATE = "SELECT o_orderkey::VARCHAR AS judgment_id, o_custkey::VARCHAR AS artifact_id, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 10 <> 0)"


@query(f"SELECT judgment_id, artifact_id FROM ({_GATE})")
def judgment_gate(spark, sf_dir):
    """Judgments of artifacts that passed and are there."""
    return stored(spark, sf_dir, judged=True).judgments().select("judgment_id", "artifact_id")


@query(f"SELECT judgment_id, artifact_id, CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS placeholder_count, CASE WHEN o_custkey % 2 = 0 THEN 'business_name,person_name' ELSE 'person_name' END AS kinds FROM ({_GATE})")
def reveal_report(spark, sf_dir):
    """Every judgment with counts and kinds of its artifact's entries, never their values."""
    return stored(spark, sf_dir, judged=True).reports().select("judgment_id", "artifact_id", "placeholder_count", F.array_join("field_types", ",").alias("kinds"))


@query("SELECT c_custkey::VARCHAR AS artifact_id, CASE WHEN c_custkey % 4 <> 0 THEN 'passed' ELSE 'failed' END AS verification_status FROM customer WHERE c_custkey % 10 <> 0 ORDER BY c_custkey % 3 DESC, 1 LIMIT 20")
def recent_artifacts(spark, sf_dir):
    """The last artifacts that were saved, as listings show them; the limit is the feature."""
    return stored(spark, sf_dir).recent(20).select("artifact_id", "verification_status")


@query("SELECT c_custkey::VARCHAR AS artifact_id, 'person_name' AS field_type, sha256(c_name) AS original_sha256 FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 10 <> 0 UNION ALL SELECT c_custkey::VARCHAR, 'business_name', sha256(c_mktsegment) FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 10 <> 0 AND c_custkey % 2 = 0")
def stored_entries(spark, sf_dir):
    """The reveal entries that are left after a deletion."""
    return stored(spark, sf_dir).entries().select("artifact_id", "field_type", "original_sha256")


@query(f"WITH {N.NOTES} SELECT note_id, CAST(len(list_filter([person, org, 'absent', person], x -> contains(raw, x))) - 1 AS INTEGER) AS n_spans, person AS first FROM notes".replace("x -> ", "lambda x: "))
def sft_targets(spark, sf_dir):
    spans = training.target_spans(F.col("raw"), F.array("person", "org", F.lit("absent"), "person"), F.array(F.lit("person_name"), F.lit("business_name")))
    rows = once(N.notes(spark, sf_dir), {"spans": spans})
    return rows.select("note_id", F.size("spans").alias("n_spans"), F.get("spans", F.lit(0))["text"].alias("first"))


@query(f"WITH {N.NOTES} SELECT note_id AS line_no, CASE WHEN row_number() OVER (ORDER BY note_id DESC) <= 50 THEN 'val' ELSE 'train' END AS split FROM notes")
def sft_split(spark, sf_dir):
    return training.split(training.examples(N.cases(spark, sf_dir))).select("line_no", "split")


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def text_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query(f"""WITH {N.NOTES}, s AS (SELECT note_id, concat('Person_1 at ', CASE WHEN org LIKE 'Midland%' THEN 'a regional location' ELSE 'Org_1' END, ' ', CASE WHEN status = 'likes the work' THEN status ELSE 'a private client status' END, '. Budget is ',
CASE WHEN budget::INT < 50 THEN 'a small daily budget' WHEN budget::INT <= 150 THEN 'a modest daily budget' WHEN budget::INT <= 500 THEN 'a significant daily budget' ELSE 'a business budget amount' END, ' in a regional location. Mail Email_1 about account Account_1 by ',
CASE WHEN CAST(substr(day, 1, 4) AS INT) > 2026 THEN 'a future date' ELSE 'a recent date' END, '. Files in Path_1 Graded by Model_1 and Person_1.') AS safe FROM notes)
SELECT 'case_' || lpad(CAST(note_id AS VARCHAR), 6, '0') AS artifact_id, safe AS safe_text, 'passed' AS verification_status, 'passed=True; hard=0; near=0; numeric=0; reveal_map=0; coreference=0; warnings=0' AS verification_summary, sha256(safe) AS safe_sha256 FROM s""")
def blind_notes(spark, sf_dir):
    """Every note blinded and verified with its own values, none of which helped to find spans."""
    cases = N.cases(spark, sf_dir).withColumnRenamed("case_id", "artifact_id")
    out = blinded(cases, POLICY, canaries="canaries", kinds="expected_field_types", fixture_transform=False, ascii_only=True)
    return out.select("artifact_id", "safe_text", "verification_status", "verification_summary", "safe_sha256")


@query()
def blind_documents(spark, sf_dir):
    """Every document of the corpus blinded; no values are known beforehand."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("artifact_id"), "text")
    out = blinded(docs, POLICY, text="text")
    return out.select("artifact_id", F.size("hidden_field_types").alias("n_kinds"), F.size("reveal_entries").alias("n_entries"), "safe_sha256", "verification_status")


@query()
def eval_suite(spark, sf_dir):
    """The notes as a suite, with the planted values' help."""
    return evaluate.totals(evaluate.evaluated(N.cases(spark, sf_dir), POLICY))


@query()
def eval_suite_fixture_off(spark, sf_dir):
    return evaluate.totals(evaluate.evaluated(N.cases(spark, sf_dir), POLICY, fixture_transform=False))


@query()
def corpus_cases(spark, sf_dir):
    """As many generated cases as there are customers, evaluated."""
    n = table(spark, sf_dir, "customer").count()
    return evaluate.per_case(evaluate.evaluated(generated_cases(spark, n), POLICY)).select("case_id", "verification_passed", "verification_summary")
