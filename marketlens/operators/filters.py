"""Filters, searches and the row selections of the collection runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.literals import typed
from marketlens.functions.parse import MISSING
from marketlens.operators.lookup import lookup_join
from marketlens.operators.numbering import with_position


def contains(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose text contains ``text``, case-sensitive; ``%`` and ``_`` are wildcards, a backslash is not."""
    pattern = text.replace("\\", "\\\\")
    return df.where(F.col(column).like(f"%{pattern}%"))


def equals(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == typed(df, column, value))


def greater(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) > typed(df, column, value))


def less(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) < typed(df, column, value))


def between(df: DataFrame, column: str, low, high) -> DataFrame:
    """Both ends included."""
    return df.where(F.col(column).between(typed(df, column, low), typed(df, column, high)))


def is_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def in_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Both ends included, each optional; at least one is needed."""
    if low is None and high is None:
        raise ValueError("give at least one end of the range")
    if low is not None:
        df = df.where(F.col(column) >= typed(df, column, low))
    if high is not None:
        df = df.where(F.col(column) <= typed(df, column, high))
    return df


def in_dates(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Date range on a date or timestamp column.

    On a timestamp a bare end date means its midnight: later times of that day are out.
    """
    return in_range(df, column, start, end)


def where(df: DataFrame, condition: str) -> DataFrame:
    """Any SQL condition over the table's columns."""
    return df.where(condition)


def by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    return equals(df, key, value)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with their counts, most frequent first; NULL counts as a value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("quantidade"))
    return counts.orderBy(F.desc("quantidade"), F.asc_nulls_last("value"))


def preview(df: DataFrame, n: int = 50, key: str = "id") -> DataFrame:
    """The part of a result that is shown; the whole result stays available for export."""
    return df.orderBy(F.asc_nulls_last(key)).limit(n)


def _valid_link() -> Column:
    return F.col("link").isNotNull() & (F.col("link") != MISSING)


def needs_extra_info(restaurants: DataFrame) -> DataFrame:
    """Restaurants with a link that still lack their review count or minimum order."""
    lacking = F.col("reviews").isNull() | F.col("min_order").isNull()
    return (
        restaurants.where(lacking & _valid_link())
        .select("id", "name", "category", "link")
        .orderBy(F.asc_nulls_last("category"), F.asc_nulls_last("name"), "id")
    )


def with_link(restaurants: DataFrame, category: str | None = None) -> DataFrame:
    """Restaurants with a link, all or of one category."""
    chosen = restaurants.where(_valid_link())
    if category is not None:
        chosen = chosen.where(F.col("category") == category)
    return chosen.select("id", "name", "category", "link").orderBy(
        F.asc_nulls_last("category"), F.asc_nulls_last("name"), "id"
    )


def categories_with_link(restaurants: DataFrame) -> DataFrame:
    return (
        restaurants.where(_valid_link())
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.asc_nulls_last("category"))
    )


def restaurant_targets(restaurants: DataFrame) -> DataFrame:
    """What a menu collection run visits, in its order."""
    return restaurants.select("id", "name", "category", "link").orderBy(
        F.asc_nulls_last("category"), F.asc_nulls_last("name"), "id"
    )


def restaurants_by_category(restaurants: DataFrame, block: int = 1000) -> DataFrame:
    """Restaurants of each category as lists ordered by name, ``block`` entries a row.

    A category of any size is spread over as many rows (``part`` 0, 1, ...) as it
    needs, so no row grows with the data. Positions come from a range sort over
    the whole table rather than from one task per category.
    """
    ordered = with_position(
        restaurants.select("category", "name", "id", "link"),
        [F.asc_nulls_last("category"), F.asc_nulls_last("name"), F.asc("id")],
        "_at",
    )
    first = ordered.groupBy("category").agg(F.min("_at").alias("_first"))
    placed = lookup_join(ordered, first, "category", null_safe=True)
    part = F.floor((F.col("_at") - F.col("_first")) / block).cast("int")
    return (
        placed.withColumn("part", part)
        .groupBy("category", "part")
        .agg(F.sort_array(F.collect_list(F.struct("_at", "id", "name", "link"))).alias("_rows"))
        .select(
            "category",
            "part",
            F.transform(
                "_rows", lambda row: F.struct(row["id"].alias("id"), row["name"].alias("name"), row["link"].alias("link"))
            ).alias("restaurants"),
        )
    )


def category_targets(categories: DataFrame) -> DataFrame:
    """What a restaurant collection run visits, in its order."""
    return categories.select("categorias", "links").orderBy(F.asc_nulls_last("categorias"), "id")
