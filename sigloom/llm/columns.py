"""Extra columns, whatever their names: carried as one struct beside the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """The column of exactly this name, points and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def rest(docs: DataFrame) -> Column:
    """All columns but text as the struct ``rest``, whose fields are r0, r1 .. by place; so no name can clash."""
    fields = [col(c).alias(f"r{i}") for i, c in enumerate(docs.columns) if c != "text"]
    return F.struct(*(fields or [F.lit(1).alias("r")])).alias("rest")


def rest_field(docs: DataFrame, name: str) -> Column:
    """A column of ``docs`` inside ``rest``."""
    return F.col("rest").getField(f"r{docs.columns.index(name)}")


def unpacked(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, in their order, from a table of ``rest`` and ``text``."""
    return [F.col("text") if c == "text" else rest_field(docs, c).alias(c) for c in docs.columns]
