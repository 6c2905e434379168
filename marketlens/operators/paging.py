"""Pages, latest rows and previews, always in a total order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.literals import typed
from marketlens.operators.numbering import with_position


# Rows among which a page is found by a sort; more are narrowed down first, by so many quantiles at a time.
FEW = 250_000
QUANTILES = 64


def _ordered(column: str, falling: bool) -> Column:
    return F.desc_nulls_last(column) if falling else F.asc_nulls_last(column)


def _sorted_part(df: DataFrame, order: list[tuple[str, bool]], skip: int, size: int) -> DataFrame:
    return df.orderBy(*[_ordered(*part) for part in order]).offset(skip).limit(size)


def _parts(df: DataFrame, order: list[tuple[str, bool]], at: int, skip: int, size: int) -> list[DataFrame]:
    """Frames that together are rows skip to skip + size of ``df`` in this order; the columns before ``at`` have one value.

    Quantiles of the column divide its values into points and the intervals between them; one count of each tells where the
    rows are. Only a filter remains, which the scan can use. A value that very many rows share is a point, and the next
    column divides its rows.
    """
    name, falling = order[at]
    shares = [i / QUANTILES for i in range(1, QUANTILES)]
    total, found = df.agg(F.count(F.lit(1)), F.percentile_approx(name, shares, 10_000)).first()
    size = min(size, total - skip)
    if size <= 0 or total <= FEW:
        return [_sorted_part(df, order, skip, size)] if size > 0 else []
    value, kind = F.col(name), df.schema[name].dataType
    edges = [F.lit(edge).cast(kind) for edge in sorted(set(found or []))]
    below = sum((F.when(value > edge, 1).otherwise(0) for edge in edges), F.lit(0))
    point = value.isin(edges) if edges else F.lit(False)
    place = F.when(value.isNull(), -1).otherwise(2 * below + point.cast("int"))
    # At most two rows per quantile.
    counts = {row[0]: row[1] for row in df.groupBy(place.alias("place")).agg(F.count(F.lit(1))).collect()}
    nulls = counts.pop(-1, 0)
    before, parts = 0, []
    for number in [*sorted(counts, reverse=falling), -1]:
        rows = nulls if number < 0 else counts[number]
        low, high = max(skip, before), min(skip + size, before + rows)
        if low < high:
            single = number < 0 or number % 2 == 1
            if number < 0:
                chosen = df.where(value.isNull())
            elif single:
                chosen = df.where(value == edges[number // 2])
            else:
                chosen = df.where(value > edges[number // 2 - 1]) if number else df
                chosen = chosen.where(value < edges[number // 2]) if number // 2 < len(edges) else chosen
            if rows <= FEW or (single and at + 1 == len(order)):
                parts.append(_sorted_part(chosen, order, low - before, high - low))
            else:
                parts += _parts(chosen, order, at + single, low - before, high - low)
        before += rows
    return parts


def _slice(df: DataFrame, order: list[tuple[str, bool]], number: int, size: int) -> DataFrame:
    """Rows by position in ``order`` (column, whether falling): nothing is written, and only rows near the page are sorted.

    Columns without quantiles (texts) are sorted by ranges and numbered instead. Whoever knows the last key of the page
    before should use ``page_after``, which counts nothing.
    """
    if number < 1:
        raise ValueError("pages are numbered from 1")
    offset = (number - 1) * size
    kinds = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    if not all(isinstance(df.schema[name].dataType, kinds) for name, _ in order):
        placed = with_position(df, [_ordered(*part) for part in order], "_at")
        wanted = placed.where((F.col("_at") >= offset) & (F.col("_at") < offset + size))
        return wanted.orderBy("_at").drop("_at")
    parts = _parts(df, order, 0, offset, size)
    if not parts:
        return df.limit(0)
    return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).orderBy(*[_ordered(*part) for part in order])


def _check_size(size: int, low: int) -> None:
    if not low <= size <= 100:
        raise ValueError(f"page size must be {low} to 100")


def page(df: DataFrame, number: int, size: int = 20, condition: str | None = None, key: str = "id") -> DataFrame:
    """One page in key order, of all rows or of those meeting a condition."""
    _check_size(size, 1)
    chosen = df if condition is None else df.where(condition)
    return _slice(chosen, [(key, False)], number, size)


def page_count(df: DataFrame, size: int = 20, condition: str | None = None) -> DataFrame:
    """Rows and pages, counted after the condition."""
    chosen = df if condition is None else df.where(condition)
    return chosen.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / size).cast("bigint").alias("pages")
    )


def page_latest(df: DataFrame, number: int, size: int = 20, key: str = "id") -> DataFrame:
    """One page, highest key first."""
    _check_size(size, 1)
    return _slice(df, [(key, True)], number, size)


def page_ordered(
    df: DataFrame, number: int, size: int = 20, column: str = "id", direction: str = "desc", key: str = "id"
) -> DataFrame:
    """One page by any column and direction; equal values are ordered by key."""
    _check_size(size, 5)
    if direction not in ("asc", "desc"):
        raise ValueError("direction is asc or desc")
    main = (column, direction == "desc")
    order = [main] if column == key else [main, (key, False)]
    return _slice(df, order, number, size)


def page_after(df: DataFrame, last_key, size: int = 20, key: str = "id") -> DataFrame:
    """The page that follows a known last key: a filtered top-k, however deep."""
    _check_size(size, 1)
    return df.where(F.col(key) > typed(df, key, last_key)).orderBy(F.asc(key)).limit(size)


def latest(df: DataFrame, n: int = 10, key: str = "id") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(key)).limit(n)


def sample_rows(df: DataFrame, n: int = 5, key: str = "id") -> DataFrame:
    """The rows shown before a change, lowest key first."""
    return df.orderBy(F.asc_nulls_last(key)).limit(n)
