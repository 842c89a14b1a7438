"""Numbers in text, as digits, in words and as ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.normalize import words
from hushframe.functions.patterns import BUDGET_WORDS, NUMBER, NUMBER_WORDS, RANGE
from hushframe.functions.steps import let


def number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def digit_numbers(text: Column) -> Column:
    """array<double> of the numbers that are written in digits."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), number)


def _values(table: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for item in table.items() for x in item))


def _spell(tokens: Column, table: dict[str, int], first_only: bool) -> Column:
    """array<double>: runs of number words, each as one number; a hundred multiplies what stands before it."""
    values = _values(table)
    start = F.struct(F.lit(-1.0).alias("now"), F.array().cast("array<double>").alias("done"))

    def step(acc: Column, amount: Column) -> Column:
        before = F.greatest(acc["now"], F.lit(0.0))
        grown = F.when(amount.isin(100.0, 1000.0) if 1000 in table.values() else amount == 100.0, F.greatest(before, F.lit(1.0)) * amount).otherwise(before + amount)
        flushed = F.when(acc["now"] >= 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        return F.when(amount.isNull(), F.struct(F.lit(-1.0).alias("now"), flushed.alias("done"))).otherwise(F.struct(grown.alias("now"), acc["done"].alias("done")))

    def runs(amounts: Column) -> Column:
        # Most texts have no such word: the fold runs only where there is one.
        folded = F.aggregate(F.concat(amounts, F.array(F.lit(None).cast("double"))), start, step, lambda acc: acc["done"])
        return F.when(F.exists(amounts, lambda x: x.isNotNull()), folded).otherwise(F.when(amounts.isNotNull(), F.array().cast("array<double>")))

    # Each word is looked up once.
    out = let(F.transform(tokens, lambda token: F.try_element_at(values, token).cast("double")), runs)
    return F.slice(out, 1, 1) if first_only else out


def spelled_numbers(comparable: Column) -> Column:
    """Of a comparable form: array<double>."""
    return _spell(words(comparable), NUMBER_WORDS, False)


def spelled_amount(lower: Column) -> Column:
    """The first run of the words that budgets are spelled with, or null."""
    return F.get(_spell(F.regexp_extract_all(F.replace(lower, F.lit("-"), F.lit(" ")), F.lit("[a-z]+"), F.lit(0)), BUDGET_WORDS, True), F.lit(0))


def ranges(text: Column) -> Column:
    """array<struct<low double, high double>>"""
    side = lambda group: F.transform(F.regexp_extract_all(text, F.lit(RANGE), F.lit(group)), number)
    return F.zip_with(side(1), side(2), lambda a, b: F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")))


def numbers(text: Column, comparable: Column) -> Column:
    """All numbers of a text, given its comparable form too."""
    return F.array_distinct(F.concat(digit_numbers(text), spelled_numbers(comparable)))
