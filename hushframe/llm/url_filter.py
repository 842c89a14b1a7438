"""URL filter: rules first, then a ratio of two character language models.

Rules are host and path prefixes (``net/de/`` fits the host net and all its subdomains,
and paths that start with /de/); the longest that fits decides.  What rules allow or
block is also what the two models learn from: variable-order Markov models of
characters, up to ``ORDER`` characters of context.  Only contexts that were seen are
counted, so the models grow with the labelled URLs; each order is interpolated with the
next lower one by Witten-Bell smoothing and the lowest with the uniform distribution
over all code points, and an unseen context leaves its character to the next lower one.

A URL's score is the mean over its characters of log p(accepted) - log p(rejected).
Every fifth labelled URL (by crc32) is kept out of the models and calibrates the
scores: with the means and the pooled variance of the two classes there, the log odds
are linear in the score.  A URL is allowed if its odds are at least even.

Everything is DataFrame functions.  Each distinct URL is scored once, and each distinct
cell (a character behind its context) of all URLs gets its ratio once; joins on cells
and URLs spread those that many rows have.

Defined results: a null URL is empty; an empty URL has score 0; without labelled URLs
of both classes (in the models or in the calibration) every score is even, so URLs
without a rule are allowed; repeated rows get equal verdicts and count as often as they
are there; columns named like those that are added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.shared import cut, cut_small, drop, spread_join

ORDER = 4
#: Stands before a URL's first character.
BEFORE = "\u0001"
CODE_POINTS = 0x110000
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(x: Column) -> Column:
    return F.translate(x, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda x: (len(x), x)):
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def cells(url: Column, order: int = ORDER) -> Column:
    """For each character, the string of its context (``order`` characters) and itself."""

    def behind(x: Column, c: Column) -> Column:
        return F.concat(c, x)

    of = F.regexp_extract_all(url, F.lit("(?s)."), F.lit(0))
    out = of
    for back in range(1, order + 1):
        out = F.zip_with(out, F.concat(F.array_repeat(F.lit(BEFORE), back), of), behind)
    # The contexts of the last characters have none after them.
    return F.filter(out, lambda x: x.isNotNull())


def ratios(wanted: DataFrame, seen: DataFrame, order: int = ORDER) -> DataFrame:
    """For each row of wanted (cell, ...): its columns and ratio double, log p(accepted) - log p(rejected).

    seen: (cell, n1, n0), how often accepted and rejected URLs have a cell.  A lower order's
    cells are the ends of the highest one's.
    """
    out = wanted.withColumns({"p1": F.lit(1.0 / CODE_POINTS), "p0": F.lit(1.0 / CODE_POINTS)})
    for k in range(order + 1):
        own = seen.groupBy(F.right("cell", F.lit(k + 1)).alias("x")).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        context = own.groupBy(F.substring("x", 1, k).alias("h")).agg(*(f(x) for x in ("n1", "n0") for f in (lambda x: F.sum(x).alias(f"s{x}"), lambda x: F.count_if(F.col(x) > 0).alias(f"t{x}"))))
        out = out.withColumns({"x": F.right("cell", F.lit(k + 1)), "h": F.substring(F.right("cell", F.lit(k + 1)), 1, k)}).join(own, "x", "left").join(context, "h", "left")
        new = {f"p{g}": F.when(F.col(f"sn{g}") > 0, (F.coalesce(F.col(f"n{g}"), F.lit(0)) + F.col(f"tn{g}") * F.col(f"p{g}")) / (F.col(f"sn{g}") + F.col(f"tn{g}"))).otherwise(F.col(f"p{g}")) for g in (1, 0)}
        out = out.select(*(F.col(c) for c in wanted.columns), *(v.alias(c) for c, v in new.items()))
    return out.select(*wanted.columns, (F.ln("p1") - F.ln("p0")).alias("ratio"))


def scores(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """From urls (url, c, good, aside), each once: (url, score), the mean ratio of its cells; URLs without characters are left out."""
    each = urls.select("url", "c", "good", "aside", F.explode(cells(F.col("url"), order)).alias("cell")).withColumn("key", F.xxhash64("cell"))
    learned = each.where("good IS NOT NULL AND NOT aside").groupBy("cell").agg(F.sum(F.when(F.col("good"), F.col("c")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("good"), 0).otherwise(F.col("c"))).alias("n0"))
    learned = cut_small(learned, "url_counts")
    wanted = each.groupBy("cell", "key").agg(F.count("*").alias("n"))
    known = cut_small(ratios(wanted, learned, order).withColumnRenamed("cell", "other"), "url_ratios")
    rows = spread_join(each.select("url", "cell", "key"), known, "key", "n").where("cell = other")
    out = cut_small(rows.groupBy("url").agg(F.avg("ratio").alias("score")), "url_scores")
    drop(learned, known)
    return out


def judged(pages: DataFrame, rules: dict[str, str], *, url: str = "url", order: int = ORDER) -> DataFrame:
    """The pages' columns, hushframe_host, _path, _rule, _verdict strings and _odds double (log odds of being allowed)."""
    new = [f"hushframe_{x}" for x in ("host", "path", "rule", "odds", "verdict")]
    names = [x for x in pages.columns if x not in new]
    inner = pages.select(*(F.col(f"`{x}`").alias(f"hf_c{i}") for i, x in enumerate(names))).withColumn("hf_link", F.coalesce(F.col(f"hf_c{names.index(url)}"), F.lit("")))
    by_rule = F.create_map(*(F.lit(x) for item in rules.items() for x in item)) if rules else F.create_map().cast("map<string,string>")
    host, path = host_and_path(F.col("url"))
    once = inner.groupBy(F.col("hf_link").alias("url")).agg(F.count("*").alias("c")).withColumns({"host": host, "path": path})
    once = once.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("action", F.element_at(by_rule, F.col("rule")))
    once = cut(once.withColumns({"good": F.col("action") == "allow", "aside": F.crc32(F.col("url").cast("binary")) % 5 == 0}), "urls")
    scored = once.join(scores(once, order), "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    scored = cut(scored, "scored_urls")
    line = cut(calibration(scored), "url_calibration").select("line").scalar()
    keyed = scored.select(F.xxhash64("url").alias("key"), "url", "c", "host", "path", "rule", "action", "score")
    rows = spread_join(inner.withColumn("key", F.xxhash64("hf_link")), keyed, "key", "c").where("hf_link = url")
    rows = rows.withColumn("odds", line["slope"] * (F.col("score") - line["middle"]))
    verdict = F.coalesce("action", F.when(F.col("odds") >= 0, F.lit("allow")).otherwise("block"))
    return rows.select(*(f"hf_c{i}" for i in range(len(names))), "host", "path", "rule", "odds", verdict.alias("verdict")).toDF(*names, *new)


def calibration(scored: DataFrame) -> DataFrame:
    """One row: line struct<slope, middle, ...>, so that slope * (score - middle) are the log odds; with the sizes and the accuracy on the URLs kept aside.

    Without both classes in the models, or among those, the slope is 0.
    """
    n = lambda test, x=F.col("c"): F.coalesce(F.sum(F.when(test, x)), F.lit(0))
    good, bad = F.col("good") & F.col("aside"), ~F.col("good") & F.col("aside")
    sums = scored.agg(n(F.col("good") & ~F.col("aside")).alias("k1"), n(~F.col("good") & ~F.col("aside")).alias("k0"), *(f.alias(k) for g, test in ((1, good), (0, bad)) for k, f in ((f"n{g}", n(test)), (f"s{g}", n(test, F.col("c") * F.col("score"))))))
    usable = (F.col("n1") > 0) & (F.col("n0") > 0) & (F.col("k1") > 0) & (F.col("k0") > 0)
    means = cut(sums.select("n1", "n0", usable.alias("usable"), *(F.when(usable, F.col(f"s{g}") / F.col(f"n{g}")).alias(f"m{g}") for g in (1, 0))), "url_means")
    mean = means.select(F.struct("*")).scalar()
    held = scored.where(F.col("good").isNotNull() & F.col("aside")).select("good", "score", "c", mean.alias("m"))
    away = F.col("score") - F.when(F.col("good"), F.col("m.m1")).otherwise(F.col("m.m0"))
    right = (F.col("score") >= (F.col("m.m1") + F.col("m.m0")) / 2) == F.col("good")
    fit = held.agg(F.sum(F.col("c") * away * away).alias("v"), F.sum(F.when(right, F.col("c"))).alias("right")).withColumn("m", mean)
    total, usable, zero = F.col("m.n1") + F.col("m.n0"), F.col("m.usable"), F.lit(0.0)
    slope = F.when(usable, (F.col("m.m1") - F.col("m.m0")) / (F.col("v") / total + 1e-6)).otherwise(zero)
    middle = F.when(usable, (F.col("m.m1") + F.col("m.m0")) / 2).otherwise(zero)
    return fit.select(F.struct(slope.alias("slope"), middle.alias("middle"), F.col("m.n1").alias("n_allow"), F.col("m.n0").alias("n_block"), F.when(usable, F.coalesce("right", F.lit(0)) / total).alias("accuracy")).alias("line"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    out = judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES)
    return out.select("page_id", *(F.col(f"hushframe_{x}").alias(x) for x in ("host", "path", "rule", "verdict")))


_RULE_CASES = " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for r in sorted(RULES, key=lambda x: (-len(x), x)))
_ACTION_CASES = " ".join(f"WHEN '{r}' THEN '{a}'" for r, a in RULES.items())


def _sql_order(k: int) -> str:
    """One order of the smoothing, as SQL."""
    below = f"1.0::DOUBLE / {CODE_POINTS} AS b1, 1.0::DOUBLE / {CODE_POINTS} AS b0" if k == 0 else "q.p1 AS b1, q.p0 AS b0"
    join = "" if k == 0 else f"JOIN p{k - 1} q ON q.cell = a.cell"
    smooth = ", ".join(f"CASE WHEN coalesce(s{g}, 0) > 0 THEN (coalesce(n{g}, 0) + t{g} * b{g}) / (s{g} + t{g}) ELSE b{g} END AS p{g}" for g in (1, 0))
    return f"""l{k} AS (SELECT right(cell, {k + 1}) AS x, sum(n1) AS n1, sum(n0) AS n0 FROM seen GROUP BY 1),
t{k} AS (SELECT left(x, {k}) AS h, sum(n1) AS s1, sum(n0) AS s0, count(*) FILTER (n1 > 0) AS t1, count(*) FILTER (n0 > 0) AS t0 FROM l{k} GROUP BY 1),
p{k} AS (SELECT cell, {smooth} FROM (SELECT a.cell, n1, n0, s1, s0, t1, t0, {below} FROM every a LEFT JOIN l{k} ON x = right(a.cell, {k + 1}) LEFT JOIN t{k} ON h = left(right(a.cell, {k + 1}), {k}) {join}))"""


#: DuckDB has no crc32, so the fold comes from one computed bit by bit.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(url::BLOB), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)))"
OP1_SQL = f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url FROM pages),
rest AS (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT r, page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
ruled AS (SELECT *, CASE {_RULE_CASES} END AS rule FROM h),
cell_rows AS (SELECT *, list_transform(range(1, length(url) + 1), lambda i: substr(repeat(chr(1), {ORDER}) || url, i, {ORDER + 1})) AS cells, CASE rule {_ACTION_CASES} END AS action FROM ruled),
known AS (SELECT *, CASE WHEN rule IS NOT NULL THEN xor({_CRC}, 4294967295::BIGINT) % 5 = 0 END AS aside FROM cell_rows),
seen AS (SELECT cell, count(*) FILTER (action = 'allow') AS n1, count(*) FILTER (action = 'block') AS n0 FROM (SELECT action, unnest(cells) AS cell FROM known WHERE NOT aside) GROUP BY 1),
every AS (SELECT DISTINCT unnest(cells) AS cell FROM known),
{", ".join(_sql_order(k) for k in range(ORDER + 1))},
scored AS (SELECT r, avg(ln(p1) - ln(p0)) AS ratio FROM (SELECT r, unnest(cells) AS cell FROM known) k JOIN p{ORDER} ON p{ORDER}.cell = k.cell GROUP BY 1),
fit AS (SELECT count(*) FILTER (action = 'allow') AS n1, count(*) FILTER (action = 'block') AS n0, avg(ratio) FILTER (action = 'allow') AS m1, avg(ratio) FILTER (action = 'block') AS m0, var_pop(ratio) FILTER (action = 'allow') AS v1, var_pop(ratio) FILTER (action = 'block') AS v0 FROM known JOIN scored USING (r) WHERE aside),
trained AS (SELECT count(*) FILTER (action = 'allow') AS k1, count(*) FILTER (action = 'block') AS k0 FROM known WHERE NOT aside),
line AS (SELECT CASE WHEN n1 > 0 AND n0 > 0 AND k1 > 0 AND k0 > 0 THEN (m1 - m0) / ((n1 * v1 + n0 * v0) / (n1 + n0) + 1e-6) ELSE 0 END AS slope, CASE WHEN n1 > 0 AND n0 > 0 AND k1 > 0 AND k0 > 0 THEN (m1 + m0) / 2 ELSE 0 END AS middle FROM fit, trained)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN slope * (coalesce(ratio, 0) - middle) >= 0 THEN 'allow' ELSE 'block' END) AS verdict
FROM known LEFT JOIN scored USING (r), line
"""
