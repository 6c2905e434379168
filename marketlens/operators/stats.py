"""Table listings and column profiles."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.literals import days_before
from marketlens.functions.numeric import exact_mean, mean_of, percent
from marketlens.schemas import is_numeric, is_text
from marketlens.sources.scratch import materialise


def catalog_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: its name, number of columns and number of rows."""
    counted = [
        frame.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), F.lit(len(frame.columns)).alias("columns"), "rows"
        )
        for name, frame in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def list_columns(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, nullability, default. From the schema alone: no row is read."""
    rows = [
        (position, field.name, field.dataType.simpleString(), field.nullable, field.metadata.get("default"))
        for position, field in enumerate(df.schema.fields, 1)
    ]
    return df.sparkSession.createDataFrame(rows, 'position int, `column` string, type string, nullable boolean, `default` string')


def describe(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, nullability, default, and how many values it lacks."""
    counted = df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in df.columns])
    entries = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(field.name).alias("column"),
            F.lit(field.dataType.simpleString()).alias("type"),
            F.lit(field.nullable).alias("nullable"),
            F.lit(field.metadata.get("default")).cast("string").alias("default"),
            F.col(field.name).alias("nulls"),
        )
        for position, field in enumerate(df.schema.fields, 1)
    ]
    return counted.select(F.inline(F.array(*entries)))


def _value_type(data_type: T.DataType) -> T.DataType:
    """The type columns of this kind are profiled in, together where it is the same."""
    return T.LongType() if isinstance(data_type, T.IntegralType) else data_type


def _profile(df: DataFrame, names: list[str], value_type: T.DataType) -> DataFrame:
    values = df.select([F.col(name).cast(value_type).alias(name) for name in names]).unpivot(
        [], names, "column", "value"
    )
    counted = values.where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    value, n = F.col("value"), F.col("n")
    if isinstance(value_type, T.LongType):
        value, n = value.cast("decimal(20,0)"), n.cast("decimal(18,0)")
    elif isinstance(value_type, T.DecimalType):
        n = n.cast("decimal(15,0)")
    return counted.groupBy("column").agg(
        F.min("value").cast("double").alias("min"),
        F.max("value").cast("double").alias("max"),
        mean_of(F.sum(value * n), F.sum("n")).alias("avg"),
        F.count(F.lit(1)).alias("distinct"),
        F.min("value").cast("string").alias("min_value"),
        F.max("value").cast("string").alias("max_value"),
    )


def numeric_profile(df: DataFrame) -> DataFrame:
    """Smallest, largest, mean and number of distinct non-null values of each numeric column.

    ``min`` and ``max`` are doubles; ``min_value`` and ``max_value`` are the same values as text, exact in the column's own type.
    Columns of one type are turned into (column, value) rows and counted per value
    first, with partial counts in the map tasks: their distinct counts take one scan
    of just these columns, and no value, however frequent, is collected in one place.
    """
    by_type: dict[T.DataType, list[str]] = {}
    for field in df.schema.fields:
        if is_numeric(field):
            by_type.setdefault(_value_type(field.dataType), []).append(field.name)
    return reduce(DataFrame.unionByName, [_profile(df, names, kind) for kind, names in by_type.items()])


def text_profile(df: DataFrame) -> DataFrame:
    """Distinct values, rows, missing values and completeness of each text column; same plan as above."""
    names = [field.name for field in df.schema.fields if is_text(field)]
    counted = (
        df.select(names).unpivot([], names, "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    missing = F.sum(F.when(F.col("value").isNull() | (F.col("value") == ""), F.col("n")).otherwise(0))
    per_column = counted.groupBy("column").agg(
        F.count("value").alias("distinct"), F.sum("n").alias("total"), missing.alias("null_empty")
    )
    return per_column.withColumn("completeness", percent(F.col("total") - F.col("null_empty"), F.col("total")))


def common_values(df: DataFrame, column: str, n: int = 5, max_distinct: int = 20) -> DataFrame:
    """The most common values, if the column has few enough distinct ones; else nothing."""
    # The table is read once; distinct values, which include the empty text as in the profile, are the rows of the counts.
    given = df.where(F.col(column).isNotNull())
    counts = materialise(given.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count")))
    distinct = counts.agg(F.count(F.lit(1)).alias("distinct")).scalar()
    return counts.where((F.col("value") != "") & (distinct <= max_distinct)).orderBy(F.desc("count"), "value").limit(n)


def recent(df: DataFrame, column: str, as_of: str, days: int = 1) -> DataFrame:
    """Rows of the ``days`` up to a point in time (and later)."""
    return df.where(F.col(column) >= days_before(df, column, as_of, days))


def table_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and fields of each table, with the total over all tables."""
    # Bounded: one row per table.
    everything = Window.partitionBy()
    return catalog_summary(tables).select(
        "table",
        "rows",
        F.col("columns").alias("fields"),
        F.sum("rows").over(everything).alias("total_rows"),
    )


def restaurant_stats(restaurants: DataFrame) -> DataFrame:
    return restaurants.agg(
        exact_mean(F.col("rating")).alias("avg_rating"),
        F.count_distinct("city").alias("cities"),
        F.count_distinct("category").alias("categories"),
    )


def product_stats(products: DataFrame) -> DataFrame:
    return products.agg(
        exact_mean(F.col("price")).alias("avg_price"),
        F.count_distinct("restaurant_id").alias("restaurants_with_products"),
    )


def dashboard(categories: DataFrame, restaurants: DataFrame, products: DataFrame) -> DataFrame:
    """Three counts, their sum, and the time of the latest collection; each table is read once."""

    def part(frame: DataFrame, label: str, ts_column: str) -> DataFrame:
        return frame.agg(F.count(F.lit(1)).alias("n"), F.max(ts_column).alias("last")).select(
            F.lit(label).alias("label"), "n", "last"
        )

    parts = (
        part(categories, "categories", "created_at")
        .unionByName(part(restaurants, "restaurants", "scraped_at"))
        .unionByName(part(products, "products", "scraped_at"))
    )

    def count_of(label: str):
        return F.sum(F.when(F.col("label") == label, F.col("n"))).alias(label)

    return parts.agg(
        count_of("categories"),
        count_of("restaurants"),
        count_of("products"),
        F.sum("n").alias("total"),
        F.max("last").alias("last_collected"),
    )


def size_share(tables: Mapping[str, DataFrame], bytes_per_row: int = 500) -> DataFrame:
    """Rows, estimated bytes and share of all rows of each table."""
    # Bounded: one row per table.
    everything = Window.partitionBy()
    return (
        catalog_summary(tables)
        .withColumn("estimated_bytes", F.col("rows") * bytes_per_row)
        .withColumn("_total", F.sum("rows").over(everything))
        .select(
            "table",
            "rows",
            "estimated_bytes",
            F.when(F.col("_total") > 0, percent(F.col("rows"), F.col("_total"))).otherwise(0.0).alias("share"),
        )
    )
