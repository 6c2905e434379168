"""Means and rounding that do not depend on the order rows arrive in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_of(total: Column, count: Column) -> Column:
    """``total / count`` as a double, NULL for no rows.

    Totals of integers and decimals are exact, so the result is the same however
    the rows were partitioned.
    """
    return F.try_divide(total.cast("double"), count.cast("double"))


def exact_mean(value: Column) -> Column:
    """Aggregate: mean of the non-null values of an integer or decimal column."""
    return mean_of(F.sum(value), F.count(value))


def round_half_up(value: Column, digits: int) -> Column:
    """Round a double to ``digits`` decimals by scaling to whole numbers."""
    unit = float(10**digits)
    return F.round(value * unit) / unit


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` as a double, NULL when ``whole`` is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100.0
