"""Comparable forms of strings.

The full form (compatibility normalisation, look-alike letters, case folding) has no
Spark built-in and takes one Arrow-batched pandas UDF for each row's strings
together; ASCII text takes built-ins only.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.patterns import CYRILLIC, LEET, LOOKALIKES

_ALIKE = str.maketrans(*LOOKALIKES)
_CYRILLIC = str.maketrans(*CYRILLIC)


def comparable(value: str) -> str:
    """What strings are compared by: look-alikes and case are one, white space is single."""
    if value.isascii():
        return " ".join(value.lower().split())
    return " ".join(unicodedata.normalize("NFKC", value).translate(_ALIKE).casefold().split())


@F.pandas_udf(T.ArrayType(T.StringType()))
def _comparable_all(values: pd.Series) -> pd.Series:
    return values.map(lambda row: None if row is None else [None if x is None else comparable(x) for x in row])


def normalized(values: Column, *, ascii_only: bool = False) -> Column:
    """The comparable forms of an array of strings; only arrays that are not all ASCII go through Python."""
    # White space that is one blank stays as it is.
    plain = F.transform(values, lambda x: F.trim(F.regexp_replace(F.lower(x), r"[\t\n\x0b\f\r\x1c-\x1f][\s\x1c-\x1f]*| [\s\x1c-\x1f]+", " ")))
    if ascii_only:
        return plain
    simple = F.forall(values, lambda x: F.octet_length(x) == F.char_length(x))
    return F.coalesce(_comparable_all(F.when(~simple, values)), plain)


def leet(value: Column) -> Column:
    return F.translate(value, *LEET)


def words(value: Column) -> Column:
    """The runs of ASCII letters and digits."""
    return F.regexp_extract_all(value, F.lit("[A-Za-z0-9]+"), F.lit(0))


def compact(value: Column) -> Column:
    """Of a comparable form: letters and digits only, with digits read as letters."""
    return F.regexp_replace(leet(value), "[^A-Za-z0-9]", "")


def folded_form(value: str) -> tuple[str, list[int] | None]:
    """The value character by character in a common form, and the place that each character of that comes from (None: its own)."""
    if value.isascii():
        return value.lower(), None
    out, at = [], []
    for i, c in enumerate(value):
        new = c.lower() if c < "\x80" else unicodedata.normalize("NFKC", c).translate(_CYRILLIC).casefold()
        out.append(new)
        at += [i] * len(new)
    return "".join(out), at


def places_in(text: tuple[str, list[int] | None], needle: str) -> list[tuple[int, int]]:
    """Places of the needle in a text that folded_form() gave, overlapping ones too, when both are compared in the common form."""
    where, at = text
    what, _ = folded_form(needle)
    found, start = [], where.find(what) if what else -1
    while start >= 0:
        last = start + len(what) - 1
        found.append((start, last + 1) if at is None else (at[start], at[last] + 1))
        start = where.find(what, start + 1)
    return found


def normalized_places(text: str, needle: str) -> list[tuple[int, int]]:
    """As places_in(), of one plain text."""
    return places_in(folded_form(text), needle)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))))
def normalized_places_all(text: pd.Series, needles: pd.Series) -> pd.Series:
    """For each needle of a row, its places in the row's text, which is folded once."""
    rows = []
    for value, some in zip(text, needles, strict=True):
        form = folded_form(value or "")
        rows.append([[{"start": a, "end": b} for a, b in places_in(form, x or "")] for x in (some if some is not None else [])])
    return pd.Series(rows)
