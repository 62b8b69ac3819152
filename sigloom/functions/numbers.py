"""Coercion of loosely typed values to doubles, as Column expressions.

Text numbers may have blanks around them and commas between thousands; NaN and
what isn't a number become null, so that each caller says what a missing value
means to it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_double(x: Column | str) -> Column:
    """A number, or the number that a string spells; else null."""
    text = F.regexp_replace(F.trim(col(x).cast("string")), ",", "")
    v = text.try_cast("double")
    return F.when(~F.isnan(v), v)


def to_double_or_zero(x: Column | str) -> Column:
    return F.coalesce(to_double(x), F.lit(0.0))


def bool_to_double(x: Column | str) -> Column:
    """Booleans count as 1 and 0."""
    return F.when(col(x).cast("boolean"), F.lit(1.0)).otherwise(F.lit(0.0))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
