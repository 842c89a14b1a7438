"""Cases (JSON lines), notes (whole files), and generated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CASE_TYPE = "case_id string, raw string, canaries array<string>, expected_field_types array<string>, expected_semantics array<string>, notes string"


def read_note(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw): one row a file, whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(line_no long, the case's columns, broken boolean): blank lines are left out but counted, broken ones kept and marked.

    A case is broken if it is no JSON object or has no raw text.  Lines are numbered in the
    order of the files' names and blocks: every block's lines are counted, and a line's
    number is its place in its block after the lines of the blocks before it.
    """
    place = F.monotonically_increasing_id()
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), place.alias("id"))
    # Within a block, ids rise by one a line: a block is read by one task, in order.
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    # One row for each block of the files, so their order is a small table's.
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select("file", "block", "first", before.alias("before"))
    numbered = lines.join(placed, ["file", "block"]).select((F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), F.col("value").alias("line"))
    return parse_cases(numbered)


def parse_cases(lines: DataFrame) -> DataFrame:
    """As read_cases(), from (line_no, line)."""
    parsed = lines.where(F.trim("line") != "").withColumn("case", F.from_json("line", CASE_TYPE + ", hf_bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "hf_bad"}))
    none = F.array().cast("array<string>")
    broken = F.col("case.raw").isNull() | F.col("case.hf_bad").isNotNull()
    return parsed.select(
        "line_no",
        F.coalesce("case.case_id", F.concat(F.lit("line_"), F.col("line_no"))).alias("case_id"),
        F.col("case.case_id").isNotNull().alias("named"),
        F.when(~broken, F.col("case.raw")).alias("raw"),
        *(F.coalesce(f"case.{c}", none).alias(c) for c in ("canaries", "expected_field_types", "expected_semantics")),
        "case.notes",
        broken.alias("broken"),
    )


# What generated cases are made of.
PEOPLE = ("Bob Calder", "Mary Jones", "Alex Rivera", "Nina Patel", "Greg Thompson", "Lisa Monroe", "Kevin Hartwell", "Sara Kim")
BUSINESSES = ("Smith Roofing", "Riverbend Dental", "True North Insurance", "Midland Lawn Services", "Oak Street Clinic", "Blue Lantern Media")
BUDGETS = ("$25/day", "$75/day", "$150/day", "$500/month", "$1,200/month", "20% commission")
PLACES = ("Grand Rapids", "Midland", "Detroit", "Henderson", "Saginaw")
STATUSES = ("likes the work but is nervous about budget", "will not launch until billing is fixed", "wants to wait until after a private call", "is unhappy with the invoice", "is ready if the account issue is resolved", "only agreed verbally", "mentioned a competitor privately")
TEMPLATES = (
    "{person} at {business} {status}. Budget is {budget} in {location}.",
    "## CRM note\n- Contact: {person}\n- Company: {business}\n- Market: {location}\n- Terms: {budget}\n- Status: {status}",
    "From: {email}\nSubject: launch\nCall {phone}. {business} {status}; proposed spend {budget}.",
    '{{"contact":"{person}","org":"{business}","city":"{location}","budget":"{budget}","note":"{status}"}}',
    'LOG client={business} owner={person} path={path} budget={budget} status="{status}"',
    "// TODO: Follow up with {person} from {business}; {status}; keep {budget} private.",
    "{person} ({email}) said {business} in {location} {status}. Account {account} has {budget}.",
    "weird casing note: {person} / {business} / {location} / {budget}. client {status}.",
)


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template as a concatenation."""
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts += [F.lit(text)] * bool(text) + ([values[name]] if name else [])
    return F.concat(*parts)


def generated_cases(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n cases (line_no long and the columns of CASE_TYPE), each determined by its number and the seed.

    Any part of them can be made anywhere; the choices follow a hash, so they are
    distributed like those of other generators but not equal to them.
    """
    draw = lambda name, k: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("line_no")), F.lit(k)).cast("int")
    pick = lambda name, some: F.get(F.array(*map(F.lit, some)), draw(name, len(some)))
    rows = spark.range(1, n + 1).withColumnRenamed("id", "line_no")
    rows = rows.select("line_no", pick("person", PEOPLE).alias("person"), pick("business", BUSINESSES).alias("business"), pick("budget", BUDGETS).alias("budget"), pick("location", PLACES).alias("location"), pick("status", STATUSES).alias("status"), draw("template", len(TEMPLATES)).alias("template"))
    rows = rows.withColumns({
        "email": F.concat(F.replace(F.lower("person"), F.lit(" "), F.lit(".")), F.lit("@example.test")),
        "phone": F.concat_ws("-", F.lit("555"), (draw("phone", 800) + 200).cast("string"), (draw("line", 9000) + 1000).cast("string")),
        "account": F.concat(F.lit("acct_"), F.substring(F.sha2(F.concat_ws("/", F.lit(str(seed)), F.col("line_no")), 256), 1, 12)),
        "path": F.concat(F.lit("/home/team/"), F.replace(F.lower("business"), F.lit(" "), F.lit("-")), F.lit("/brief.md")),
    })
    values = {c: F.col(c) for c in ("person", "business", "budget", "location", "status", "email", "phone", "account", "path")}
    raw = None
    for i, template in enumerate(TEMPLATES):
        raw = F.when(F.col("template") == i, filled(template, values)) if raw is None else raw.when(F.col("template") == i, filled(template, values))
    rows = rows.withColumn("raw", raw)
    kinds = {"person": "person_name", "business": "business_name", "budget": "budget", "location": "location", "status": "client_status", "email": "email", "phone": "phone", "account": "account_id", "path": "file_path"}
    always = ("person", "business", "budget", "location", "status")
    planted = F.filter(F.array(*(F.struct(F.col(c).alias("value"), F.lit(k).alias("kind"), (F.lit(c in always) | F.contains("raw", F.col(c))).alias("there")) for c, k in kinds.items())), lambda x: x["there"])
    return rows.select(
        "line_no",
        F.format_string("case_%03d", "line_no").alias("case_id"),
        "raw",
        F.transform(planted, lambda x: x["value"]).alias("canaries"),
        F.transform(planted, lambda x: x["kind"]).alias("expected_field_types"),
        F.array(F.lit("client context preserved at a safe level")).alias("expected_semantics"),
        F.lit("synthetic").alias("notes"),
    )


#: Phrases of held-out cases, by kind: none of them is a fixed phrase, a listed place or a name of generated_cases().
HELDOUT = {
    "business_relationship": ("the bookkeeper who vouched for them", "their go-between in the paving trade", "whoever countersigned the lease", "the cousin that keeps their ledgers", "our old liaison at the orchard"),
    "client_status": ("keeps postponing the kickoff", "has second thoughts since the estimate", "asked for a quiet month before paying", "hinted at another bidder", "wants the handover hushed up"),
    "business_name": ("Copperfield Dental", "Juniper Hill Media", "Saltmarsh Plumbing", "Winterbourne Clinic", "Fernleigh Solutions"),
    "person_name": ("Imogen Farley", "Oskar Lindqvist", "Teodora Banu", "Hakim Sowell", "Brigid Malone"),
    "model_name": ("the tiny model in the basement rack", "a rented judge model", "that cloud routing model"),
    "file_path": ("/srv/drop/ledger.csv", "~/var/quotes/final.txt", "/opt/intake/notes.md"),
    "location": ("Port Huron", "Traverse Bay", "Owosso", "Marquette"),
    "budget": ("$95 per day", "$640/month", "a 14% cut", "$2,300/month"),
    "private_note": ("nobody but the owner may hear of it", "leave the brother out of this", "not a word to the landlord"),
}
#: How often each kind is in a case, in percent, and what stands before its phrase.
HELDOUT_SHARE = {"business_relationship": (50, "Met "), "client_status": (100, "; the account "), "business_name": (65, "; it is about "), "person_name": (45, ". Copy in "), "model_name": (30, "; graded by "), "file_path": (28, "; filed under "), "location": (30, "; near "), "budget": (35, "; offered "), "private_note": (18, "; ")}


def heldout_cases(spark: SparkSession, n: int, seed: int = 42, phrases: dict[str, tuple[str, ...]] = HELDOUT) -> DataFrame:
    """n cases of generated_cases()'s kinds in other words, to measure what detectors know by heart.

    Every planted value is in its text as it is; a case where one is not stops the job.
    """
    draw = lambda name, k: F.pmod(F.xxhash64(F.lit(seed), F.lit("heldout"), F.lit(name), F.col("line_no")), F.lit(k)).cast("int")
    parts = [F.struct(F.get(F.array(*map(F.lit, phrases[kind])), draw(kind, len(phrases[kind]))).alias("value"), F.lit(kind).alias("kind"), F.lit(lead).alias("lead"), (draw(f"{kind}?", 100) < share).alias("there")) for kind, (share, lead) in HELDOUT_SHARE.items() if phrases.get(kind)]
    rows = spark.range(1, n + 1).withColumnRenamed("id", "line_no").withColumn("parts", F.filter(F.array(*parts), lambda x: x["there"]))
    raw = F.concat(F.regexp_replace(F.array_join(F.transform("parts", lambda x: F.concat(x["lead"], x["value"])), ""), r"^[;. ]+", ""), F.lit("."))
    rows = rows.withColumn("raw", raw).withColumn("canaries", F.transform("parts", lambda x: x["value"]))
    checked = F.when(F.forall("canaries", lambda c: F.contains("raw", c)), F.col("raw")).otherwise(F.raise_error(F.concat(F.lit("a planted value is not in its text: "), F.col("raw"))))
    return rows.select(
        "line_no",
        F.format_string("heldout_%03d", "line_no").alias("case_id"),
        checked.alias("raw"),
        "canaries",
        F.transform("parts", lambda x: x["kind"]).alias("expected_field_types"),
        F.array(F.lit("who and what is meant stays private")).alias("expected_semantics"),
        F.lit("held out").alias("notes"),
    )


def write_cases(cases: DataFrame, path: str) -> None:
    """JSON lines, in line order, fields by name."""
    names = sorted(c for c in cases.columns if c != "line_no")
    cases.repartitionByRange("line_no").sortWithinPartitions("line_no").select(*names).write.mode("overwrite").json(path)
