"""Places of matches are those of a plain search, whatever the text holds; patterns that cannot match are not tried."""

from pyspark.sql import functions as F

from hushframe.functions import patterns as P
from hushframe.functions.normalize import normalized
from hushframe.functions.spans import folded, may_match, places

TEXTS = {
    "a 2024-01-02, 2025-03-04": [(2, "2024-01-02"), (14, "2025-03-04")],
    "2024-01-02": [(0, "2024-01-02")],
    "é 😀 2024-01-02": [(4, "2024-01-02")],
    "\x01 2024-01-02 \x01\x012025-03-04\x01": [(2, "2024-01-02"), (15, "2025-03-04")],
    "\x01": [],
    "": [],
    "none $0 \\": [],
}


def test_places(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string").select("t", places(F.col("t"), P.DATE).alias("p")).collect()
    assert {r.t: [(x.start, x.text) for x in r.p] for r in rows} == TEXTS | {None: []}


def test_a_role_needs_its_determiner(spark):
    rows = spark.createDataFrame([("files in /home/team/x",), ("their team",)], "t string")
    assert [r.m for r in rows.select(may_match(F.col("t"), folded(F.col("t")), P.RELATION_ROLE).alias("m")).collect()] == [False, True]


def test_white_space_is_single(spark):
    rows = spark.createDataFrame([(["a b", " a \t b\n", "a\x1c\x1fb  c", "\x0b \x0ba"],)], "v array<string>")
    assert rows.select(normalized(F.col("v"), ascii_only=True).alias("n")).first().n == ["a b", "a b", "a b c", "a"]
