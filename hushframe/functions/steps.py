"""Steps of a plan that are evaluated once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The columns added (or replaced), each evaluated once a row however often, and in whatever lambdas, it is used above.

    The optimizer merges projections, and an expression that a lambda refers to would
    be evaluated again for every element.  A generator of one row is a step that it
    does not merge; it adds no shuffle.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(value.alias(name) for name, value in columns.items())))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where the value is evaluated once however often the body uses it; for use within expressions, where once() cannot go."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
