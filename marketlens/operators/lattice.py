"""Reports at several levels of detail at once: sums and counts at the finest level, coarser ones from finer ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numeric import mean_of
from marketlens.sources.scratch import materialise


def cube(dimensions: Sequence[str]) -> list[tuple[str, ...]]:
    return [level for n in range(len(dimensions), -1, -1) for level in combinations(dimensions, n)]


def rollup(dimensions: Sequence[str]) -> list[tuple[str, ...]]:
    return [tuple(dimensions[:n]) for n in range(len(dimensions), -1, -1)]


def lattice(
    df: DataFrame, dimensions: Sequence[str], values: Mapping[str, Column], levels: Sequence[Sequence[str]] | None = None
) -> DataFrame:
    """Rows, and per value its non-null count, sum and mean, for every group of every level (default: the cube).

    ``level`` names the level's dimensions, comma-joined; the others are null, and so may values of the level's own be. Each
    value is an integer or a decimal, so every sum is exact whatever it was added up from. The table is read
    once and its rows are not multiplied: a level is summed from the smallest one above it that has its dimensions.
    """
    wanted = [tuple(level) for level in (cube(dimensions) if levels is None else levels)]
    finest = tuple(dimensions)
    first = [F.count(F.lit(1)).alias("rows")]
    for name, value in values.items():
        first += [F.count(value).alias(f"{name}_n"), F.sum(value.cast("decimal(38,4)")).alias(f"{name}_sum")]
    sums = ["rows", *[f"{name}_{part}" for name in values for part in ("n", "sum")]]
    made = {finest: materialise(df.groupBy(*dimensions).agg(*first))}
    for level in sorted({*wanted} - {finest}, key=len, reverse=True):
        source = min((known for known in made if set(level) <= set(known)), key=len)
        made[level] = materialise(made[source].groupBy(*level).agg(*[F.sum(name).alias(name) for name in sums]))
    kinds = {field.name: field.dataType for field in made[finest].schema.fields}

    def shown(level: tuple[str, ...]) -> DataFrame:
        parts = [F.col(d) if d in level else F.lit(None).cast(kinds[d]).alias(d) for d in dimensions]
        totals = [F.col(name).cast(kinds[name]).alias(name) for name in sums]
        means = [mean_of(F.col(f"{name}_sum"), F.col(f"{name}_n")).alias(f"{name}_mean") for name in values]
        return made[level].select(F.lit(",".join(level)).alias("level"), *parts, *totals, *means)

    return reduce(DataFrame.unionByName, [shown(level) for level in wanted])
