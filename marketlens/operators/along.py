"""What depends on the order of all rows: the last value before a row, running sums. No window runs over a key or a table.

Rows are sorted by ranges, so a frequent key is divided like any other. A window runs within each range; what a range hands on
to the next ones is one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from marketlens.operators.numbering import in_order


def _within() -> WindowSpec:
    return Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before() -> WindowSpec:
    """Over one row per range."""
    return Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], tie: str
) -> DataFrame:
    """Every row of ``left`` with ``values`` of the last row of ``right`` for the same keys that is not later; null if there is none.

    Of several at one time the one with the largest ``tie`` counts. Null keys are keys like others; rows of ``left``
    without a time, and rows of ``right`` without, match nothing. Rows of both tables move once, and repeated ones stay.
    """
    taken = [F.col(name).alias(f"r{i}") for i, name in enumerate(values)]
    key = F.struct(*[F.col(name).alias(f"k{i}") for i, name in enumerate(keys)])
    # Numbers divide the rows of one time.
    mine = left.select(
        key.alias("_key"), F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.monotonically_increasing_id().alias("_nth")
    )
    theirs = right.where(F.col(right_time).isNotNull()).select(
        key.alias("_key"), F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.struct(*taken).alias("_right")
    )
    both = in_order(mine.unionByName(theirs, allowMissingColumns=True), [F.col(name) for name in ("_key", "_time", "_side", "_tie", "_nth")])
    # The key travels along: what is carried belongs to it only.
    carried = F.when(F.col("_side") == 0, F.struct("_key", "_right"))
    within = both.withColumn("_last", F.last(carried, ignorenulls=True).over(_within())).where("_side = 1")
    ends = both.groupBy("_part").agg(F.max_by(carried, F.when(F.col("_side") == 0, F.col("_row"))).alias("_end"))
    handed = ends.select("_part", F.last("_end", ignorenulls=True).over(_before()).alias("_handed"))
    found = within.join(F.broadcast(handed), "_part").withColumn("_found", F.coalesce("_last", "_handed"))
    fits = F.col("_found._key").eqNullSafe(F.col("_key")) & F.col("_time").isNotNull()
    results = [F.when(fits, F.col(f"_found._right.r{i}")).alias(name) for i, name in enumerate(values)]
    return found.select("_left.*", *results)


def running_sum(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with the sum of a column over all rows up to each one, in an order that must not leave ties."""
    rows = in_order(df, order)
    totals = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = totals.select("_part", F.coalesce(F.sum("_sum").over(_before()), F.lit(0)).alias("_base"))
    total = F.col("_base") + F.sum(value).over(_within())
    return rows.join(F.broadcast(before), "_part").withColumn(name, total).drop("_part", "_row", "_base")
