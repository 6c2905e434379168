"""Joining a table, whose keys may be skewed, with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.sources.scratch import materialise


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    column: str,
    key: str | None = None,
    how: str = "left",
    null_safe: bool = False,
    written: bool = False,
) -> DataFrame:
    """Join ``df`` with ``lookup``, which has one row per value of ``key`` (default: the same name).

    The lookup is written first, unless the caller has (``written``). So it is computed once, Spark
    broadcasts it by its bytes on storage, and otherwise both sides are shuffled for this join alone, which lets
    adaptive execution split the partitions of frequent keys. The lookup's key is not part of the result.
    """
    keyed = (lookup if written else materialise(lookup)).withColumnRenamed(key or column, "_key")
    same = F.col(column).eqNullSafe(F.col("_key")) if null_safe else F.col(column) == F.col("_key")
    return df.join(keyed, same, how).drop("_key")
