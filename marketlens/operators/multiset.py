"""Differences of tables without a key, with every row counted as often as it occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Copies of one row that one task makes.
COPIES = 10_000


def multiplicities(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every distinct row of both tables with ``n_left`` and ``n_right``, how often each has it.

    Rows are equal when all their values are, nulls included. Both are reduced before they move, so a row that
    a third of a table repeats travels once per task.
    """
    if left.columns != right.columns:
        raise ValueError("the tables must have the same columns")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = left.select("*", one.alias("n_left"), none.alias("n_right")).union(right.select("*", none.alias("n_left"), one.alias("n_right")))
    return both.groupBy(*left.columns).agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))


def _copied(counted: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as often as ``n`` says; many copies of one row are made by several tasks."""
    chunks = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))).alias("_chunk"))
    size = F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("_chunk") * COPIES)
    dealt = chunks.withColumn("_size", size).repartition(*columns, "_chunk")
    return dealt.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_size"))).alias("_copy")).select(*columns)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` less those of ``right``, copy by copy."""
    counted = multiplicities(left, right).withColumn("n", F.col("n_left") - F.col("n_right")).where("n > 0")
    return _copied(counted, left.columns)


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that both tables have, as often as the one with fewer."""
    counted = multiplicities(left, right).withColumn("n", F.least("n_left", "n_right")).where("n > 0")
    return _copied(counted, left.columns)
