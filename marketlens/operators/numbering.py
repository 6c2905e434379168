"""Dense row positions in a given order, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.sources.scratch import materialise

# monotonically_increasing_id() keeps the partition above this bit and the row below it.
_PARTITION_SHIFT = 33
_ROW_MASK = (1 << _PARTITION_SHIFT) - 1


def in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows sorted by ranges and written, with ``_part``, the number of their range, and ``_row``, ascending within it.

    What is computed along the order needs one window per range and then one row per range.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    written = materialise(sorted_rows.withColumn("_row", F.monotonically_increasing_id()))
    return written.withColumn("_part", F.shiftright("_row", _PARTITION_SHIFT))


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add 0, 1, 2, ... in ``order``, which must not leave ties.

    Range partitions are sorted in parallel and written to the shared folder, so
    the counts below and the rows they number are the same ones. Only one count
    per partition is summed up in a single task.
    """
    numbered = materialise(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    partition = F.shiftright("_mid", _PARTITION_SHIFT)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy(partition.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    # Bounded: one row per partition of the sort.
    placed = numbered.withColumn("_part", partition).join(F.broadcast(offsets), "_part")
    position = F.col("_offset") + F.col("_mid").bitwiseAND(F.lit(_ROW_MASK))
    return placed.withColumn(name, position).drop("_part", "_mid", "_offset")
