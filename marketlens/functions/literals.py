"""Literals in a column's own type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def typed(df: DataFrame, column: str, value) -> Column:
    """The value as a literal of the column's type.

    The column itself then needs no cast, so the comparison can be pushed into the
    scan; this matters for timestamps, which come with and without time zone.
    """
    return F.lit(value).cast(df.schema[column].dataType)


def days_before(df: DataFrame, column: str, as_of: str, days: int) -> Column:
    """The point in time ``days`` before ``as_of``, in the column's type."""
    return typed(df, column, as_of) - F.make_dt_interval(F.lit(days))
