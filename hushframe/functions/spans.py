"""Span arrays: every match of a pattern with its place, from built-in functions.

A span is a struct of SPAN_TYPE; start and end count code points and are half open.
Places come from one fold over the pieces between matches and the matches, so no
Python runs and supplementary characters count once.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.patterns import NEEDS, NEEDS_TOO
from hushframe.functions.steps import let

SPAN_TYPE = "struct<start:int,end:int,text:string,field_type:string,detector:string,confidence:double,reason:string>"
NO_SPANS = f"array<{SPAN_TYPE}>"
#: A character that no note is written with; where a text has it all the same, places() goes without.
MARK = "\x01"


def no_spans() -> Column:
    return F.array().cast(NO_SPANS)


def span(start: Column, text: Column, field_type: Column | str, detector: str, confidence: float, reason: str) -> Column:
    kind = F.lit(field_type) if isinstance(field_type, str) else field_type
    return F.struct(start.alias("start"), (start + F.char_length(text)).alias("end"), text.alias("text"), kind.alias("field_type"), F.lit(detector).alias("detector"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def in_ascii(pattern: str) -> str:
    """The pattern for texts that are all ASCII, where the Unicode meaning of letters, digits, spaces and case only costs time."""
    return re.sub(r"^\(\?(i?)[uU]+\)", lambda m: "(?i)" if m[1] else "", pattern)


def places(text: Column, pattern: Column | str) -> Column:
    """array<struct<start int, text string>> of all matches, in order; empty for a null text. A pattern matches no empty text."""
    known = isinstance(pattern, str)
    regex = F.lit(pattern) if known else pattern
    fast = F.when(is_ascii(text), F.lit(in_ascii(pattern))).otherwise(regex) if known else regex
    kind = "array<struct<start:int,text:string>>"
    none = F.array().cast(kind)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), none.alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        match = F.struct(acc["at"].alias("start"), piece.alias("text"))
        return F.struct((acc["at"] + F.char_length(piece)).alias("at"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], F.concat(acc["out"], F.array(match))).otherwise(acc["out"]).alias("out"))

    # One walk over the text puts a mark before and behind every match; between marks, every other piece is a match.
    # Most texts have no match of most patterns: the fold runs only where there is one.
    marked = F.regexp_replace(text, fast, F.lit(f"{MARK}$0{MARK}"))
    folded = lambda pieces: F.aggregate(pieces, start, step, lambda acc: acc["out"])
    of = lambda m: F.when(F.contains(m, F.lit(MARK)), folded(F.split(m, MARK, -1))).otherwise(none)
    # A text that has the mark itself is taken apart twice.
    gaps, found = F.split(text, regex, -1), F.regexp_extract_all(text, regex, F.lit(0))
    slow = folded(F.flatten(F.zip_with(gaps, found, lambda g, h: F.filter(F.array(g, h), lambda x: x.isNotNull()))))
    return F.when(F.contains(text, F.lit(MARK)), slow).otherwise(let(marked, of))


def pattern_spans(text: Column, pattern: Column | str, field_type: Column | str, reason: str, confidence: float, detector: str = "regex") -> Column:
    return F.transform(places(text, pattern), lambda p: span(p["start"], p["text"], field_type, detector, confidence, reason))


def may_match(text: Column, lower: Column, pattern: str) -> Column:
    """Whether a text can have a match of a known pattern, by what is cheap to see; ``lower``: see folded()."""
    parts, quick = NEEDS.get(pattern, ((), None))
    some = lambda tests: reduce(Column.__or__, tests) if tests else F.lit(True)
    holds = lambda parts: [F.contains(lower, F.lit(x)) for x in parts]
    first = some(holds(parts) + ([F.rlike(text, F.when(is_ascii(text), F.lit(in_ascii(quick))).otherwise(F.lit(quick)))] if quick else []))
    return some(holds(NEEDS_TOO[pattern])) & first if pattern in NEEDS_TOO else first


def folded(text: Column) -> Column:
    """Lower case in which letters that any-case patterns take for ASCII ones (long s, dotless and dotted i, Kelvin) are those."""
    return F.lower(F.translate(text, "\u017f\u0131\u0130\u212a", "siik"))


def gated(spans: Column, test: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(NO_SPANS))


def literal(needle: str) -> str:
    """A pattern for the needle in any case."""
    return "(?iu)" + re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", needle)


def literal_column(needle: Column) -> Column:
    return F.concat(F.lit("(?iu)"), F.regexp_replace(needle, r"([\\.^$|?*+()\[\]{}])", r"\\$1"))


def literal_spans(text: Column, needle: str | Column, field_type: Column | str, reason: str, confidence: float, detector: str) -> Column:
    return pattern_spans(text, literal(needle) if isinstance(needle, str) else literal_column(needle), field_type, reason, confidence, detector)
