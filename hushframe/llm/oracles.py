"""SQL for DuckDB that gives the rows of queries which SQL can express by other means."""

from __future__ import annotations

from hushframe.llm.quality_rules import BIT, DEFAULT, RULES
from hushframe.llm.url_filter import OP1_SQL

_SPACED = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BITS = " + ".join(
    f"CASE WHEN {test} THEN {BIT[name]} ELSE 0 END"
    for name, test in (
        ("short", "n_words < 50"),
        ("repeated_words", "n_repeat_words > 0.5::DOUBLE * n_words"),
        ("short_words", "word_chars < 2 * n_words"),
        ("long_words", "word_chars > 14 * n_words"),
        ("symbols", "n_symbols > 0.3::DOUBLE * n_words"),
        ("duplicate_lines", "n_dup_lines > 0.5::DOUBLE * n_lines"),
        ("upper_case", "n_upper > 0.6::DOUBLE * word_chars"),
        ("ellipsis_lines", "n_dots > 0.5::DOUBLE * n_lines"),
    )
)
OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, regexp_extract_all(text, '{_SPACED}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_SPACED}')) AS ls FROM d),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM s),
g AS (SELECT r, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
n AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c) AS n FROM g WHERE c IS NOT NULL),
hit AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM n, (VALUES (0), (1), (2)) t(j) WHERE n.n > 1 GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
len(ls) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, len(list_filter(ls, lambda x: regexp_matches(x, '\.\.\.[\x20\x09-\x0D]*$'))) AS n_dots FROM s LEFT JOIN hit USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST({_BITS} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fail_bits & {DEFAULT.mask} = 0 AS kept, fail_bits FROM f
"""

ABLATIONS_SQL = f"WITH f AS ({OP5_SQL}), b AS (SELECT fail_bits & {DEFAULT.mask} AS b FROM f) " + " UNION ALL ".join(
    f"SELECT '{rule.name}' AS rule, count(*) FILTER (b & {BIT[rule.name]} <> 0) AS rejected, count(*) FILTER (b = {BIT[rule.name]}) AS only, count(*) FILTER (b = 0 OR b = {BIT[rule.name]}) AS kept_without, '{DEFAULT.name}' AS policy, {DEFAULT.version} AS version FROM b" for rule in RULES if rule.name in DEFAULT.rules
)

_BASE32 = "array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, CAST(5 * g + 1 AS INT), 5))::BIGINT >> k) & 31 AS INT) + 1, 1)), '')), '')"
OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
t AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS target FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
CASE WHEN target IS NULL OR page_id IS NOT DISTINCT FROM target THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id IS DISTINCT FROM target THEN target END AS refers_to FROM t
"""

_FOLDED = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_FOLDED} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, ws[k:k + least(len(ws), 13) - 1] AS v FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS k FROM b WHERE len(ws) > 0)),
w AS (SELECT r, ws, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
hits AS (SELECT r, item, i, len(v) AS n FROM w JOIN win ON word = v[1] AND ws[i:i + len(v) - 1] = v),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS names FROM hits GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""

ORACLE_SQL = {"op1_url_filter": OP1_SQL, "op5_quality_rules": OP5_SQL, "quality_ablations": ABLATIONS_SQL, "op7_warc": OP7_SQL, "op9_decontaminate": OP9_SQL}
