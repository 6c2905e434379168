"""Value checks, quality score and latency grade as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.numeric import round_half_up
from marketlens.functions.parse import strip

# Words accepted as a boolean.
BOOLEAN_WORDS = ["true", "false", "1", "0", "sim", "não", "s", "n"]


def is_missing(value: Column, is_text: bool) -> Column:
    """NULL, or the empty text for text columns."""
    return (value.isNull() | (value == "")) if is_text else value.isNull()


def is_valid(value: Column, type_name: str) -> Column:
    """Whether a raw text is acceptable for a column type; NULL is not."""
    kind = type_name.upper()
    if "INT" in kind:
        ok = strip(value).rlike(r"^[+-]?\d+$")
    elif "DECIMAL" in kind or "NUMERIC" in kind:
        ok = strip(value).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
    elif "BOOLEAN" in kind:
        ok = F.lower(value).isin(BOOLEAN_WORDS)
    elif "DATE" in kind:
        dashes = F.length(value) - F.length(F.replace(value, F.lit("-"), F.lit("")))
        ok = (F.length(value) == 10) & (dashes == 2)
    else:
        ok = value.isNotNull()
    return F.coalesce(ok, F.lit(False))


def quality_score(rows: Column, columns: Column, nulls: Column, issues: Column) -> Column:
    """0 to 100: up to 50 points off for empty fields, up to 30 for issues; an empty table has 100."""
    null_percent = F.try_divide(nulls.cast("double"), (rows * columns).cast("double")) * 100.0
    score = (
        F.lit(100.0)
        - F.least(null_percent * 2.0, F.lit(50.0))
        - F.least((issues * 10).cast("double"), F.lit(30.0))
    )
    return F.when(rows == 0, F.lit(100.0)).otherwise(round_half_up(F.greatest(score, F.lit(0.0)), 1))


def quality_band(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 70, "good").otherwise("low")


def latency_grade(seconds: Column) -> Column:
    return (
        F.when(seconds < 0.1, "excellent")
        .when(seconds < 0.5, "good")
        .when(seconds < 1.0, "acceptable")
        .otherwise("slow")
    )
