"""Helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | str | int | float


def col(value: Value) -> Column:
    """A column itself, a column of that name, or a literal number."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def trunc(value: Column) -> Column:
    """Towards zero, as a long; nulls stay null."""
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("long")


def narrow(value: Column) -> Column:
    """Rounded to single precision."""
    return value.cast("float")


def short_number(value: Column, decimals: int = 2) -> Column:
    """At most so many decimals, without trailing zeros."""
    return F.regexp_replace(F.format_string(f"%.{decimals}f", F.round(value, decimals)), r"\.?0+$", "")
