"""Ranking and aggregation reports."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numeric import exact_mean, round_half_up

MONEY = "decimal(10,2)"


def top_rated(restaurants: DataFrame, n: int = 10) -> DataFrame:
    return (
        restaurants.where(F.col("rating").isNotNull())
        .orderBy(F.desc("rating"), F.asc_nulls_last("name"), "id")
        .limit(n)
        .select("name", "category", "rating", "city", "delivery_fee")
    )


def category_summary(restaurants: DataFrame) -> DataFrame:
    return (
        restaurants.groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("total"),
            exact_mean(F.col("rating")).alias("avg_rating"),
            F.min("delivery_fee").alias("min_delivery"),
            F.max("delivery_fee").alias("max_delivery"),
        )
        .orderBy(F.desc("total"), F.asc_nulls_last("category"))
    )


def priciest(products: DataFrame, n: int = 20) -> DataFrame:
    return (
        products.where(F.col("price").isNotNull())
        .orderBy(F.desc("price"), "id")
        .limit(n)
        .select("restaurant_name", "name", "category", "price")
    )


def delivery_stats(restaurants: DataFrame) -> DataFrame:
    """Over restaurants with a known fee."""
    fee = F.col("delivery_fee")
    return restaurants.where(fee.isNotNull()).agg(
        F.count(F.lit(1)).alias("total_restaurants"),
        F.count_if(fee == 0).alias("free_delivery"),
        round_half_up(exact_mean(fee), 2).alias("avg_delivery_fee"),
        F.min(fee).alias("min_fee"),
        F.max(fee).alias("max_fee"),
    )


def price_by_category(products: DataFrame) -> DataFrame:
    price = F.col("price")
    return (
        products.where(price.isNotNull())
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("total_products"),
            round_half_up(exact_mean(price), 2).alias("avg_price"),
            F.min(price).cast(MONEY).alias("min_price"),
            F.max(price).cast(MONEY).alias("max_price"),
        )
        .orderBy(F.desc("avg_price"), F.asc_nulls_last("category"))
    )


def without_products(restaurants: DataFrame, products: DataFrame) -> DataFrame:
    """Restaurants no product refers to.

    The referring keys are reduced to distinct ones before they are shuffled, so
    a restaurant with very many products costs one row per map task.
    """
    referred = products.select(F.col("restaurant_id").alias("id")).where("id IS NOT NULL").distinct()
    return (
        restaurants.join(referred, "id", "left_anti")
        .orderBy(F.desc_nulls_last("rating"), "id")
        .select("name", "category", "city", "rating")
    )


def totals(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: its label and number of rows."""
    counted = [
        frame.agg(F.count(F.lit(1)).alias("total")).select(F.lit(label).alias("item"), "total")
        for label, frame in frames.items()
    ]
    return reduce(DataFrame.unionByName, counted)


# The rating bands, best first, and the label of the rest.
RATING_BANDS = [
    ("4.5", "Excelente (4.5+)"),
    ("4.0", "Muito Bom (4.0-4.4)"),
    ("3.5", "Bom (3.5-3.9)"),
    ("3.0", "Regular (3.0-3.4)"),
]
LOWEST_BAND = "Baixo (<3.0)"


def rating_bands(restaurants: DataFrame) -> DataFrame:
    rating = F.col("rating")
    band = F.when(F.lit(False), F.lit(None))
    for lower, label in RATING_BANDS:
        band = band.when(rating >= F.lit(lower).cast("decimal(2,1)"), label)
    return (
        restaurants.where(rating.isNotNull())
        .groupBy(band.otherwise(LOWEST_BAND).alias("rating_category"))
        .agg(
            F.count(F.lit(1)).alias("total_restaurants"),
            round_half_up(exact_mean(rating), 2).alias("avg_rating"),
        )
        .orderBy(F.desc("avg_rating"))
    )


def category_counts(restaurants: DataFrame) -> DataFrame:
    return restaurants.groupBy("category").agg(F.count(F.lit(1)).alias("total"))


def rating_stats(restaurants: DataFrame) -> DataFrame:
    rating = F.col("rating")
    return restaurants.where(rating.isNotNull()).agg(
        exact_mean(rating).alias("avg_rating"),
        F.min(rating).alias("min_rating"),
        F.max(rating).alias("max_rating"),
    )


def collected_counts(staging: DataFrame, key: str) -> DataFrame:
    """Items a collection run brought in, per category or restaurant."""
    return staging.groupBy(key).agg(F.count(F.lit(1)).alias("collected")).orderBy(F.asc_nulls_last(key))
