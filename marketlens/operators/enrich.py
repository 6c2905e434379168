"""Filling of missing values from the category's mean, then from a default.

The means of all columns come from one grouped pass and are joined back once;
see ``lookup_join`` for how a very large or a very uneven set of categories is
handled. A row without category matches no mean and takes the default.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numeric import mean_of, percent, round_half_up
from marketlens.operators.lookup import lookup_join
from marketlens.sources.scratch import materialise

ENRICHED = ["rating", "delivery_time", "delivery_fee", "reviews", "min_order"]


@dataclass(frozen=True)
class Fill:
    """How one column is filled: decimals of the mean, type, default."""

    digits: int
    type_name: str
    default: str

    def shaped(self, mean: Column) -> Column:
        # No digits means the mean is cut to a whole number rather than rounded.
        value = round_half_up(mean, self.digits) if self.digits else mean
        return value.cast(self.type_name)


# Rounding and default of each column.
FILLS = {
    "rating": Fill(1, "decimal(2,1)", "4.0"),
    "delivery_time": Fill(0, "int", "45"),
    "delivery_fee": Fill(2, "decimal(10,2)", "5.00"),
    "min_order": Fill(2, "decimal(10,2)", "25.00"),
}


def missing_analysis(restaurants: DataFrame) -> DataFrame:
    """Missing values of the five columns and their share of all rows."""
    counts = restaurants.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(name).isNull()).alias(name) for name in ENRICHED],
    )
    long = counts.unpivot(["total"], ENRICHED, "column", "missing")
    return long.withColumn("pct", percent(F.col("missing"), F.col("total")))


def filled_counts(restaurants: DataFrame) -> DataFrame:
    """How many values ``fill_all`` fills in each column: every missing one, as there are defaults."""
    return missing_analysis(restaurants).select("column", F.col("missing").alias("affected"))


def fill_means(restaurants: DataFrame, columns: list[str]) -> DataFrame:
    """Fill the given columns from the means of their category."""
    sums = restaurants.groupBy("category").agg(
        *[F.sum(name).alias(f"_sum_{name}") for name in columns],
        *[F.count(name).alias(f"_n_{name}") for name in columns],
    )
    # One row per category, used by the join and the overall mean.
    sums = materialise(sums)
    # Rows without category are in the overall mean, but equal no category here.
    filled = lookup_join(restaurants, sums, "category", written=True)
    updates = {}
    for name in columns:
        fill = FILLS[name]
        total, count = F.col(f"_sum_{name}"), F.col(f"_n_{name}")
        values = [F.col(name), fill.shaped(mean_of(total, count))]
        if name == "rating":
            # Ratings fall back on the mean over all restaurants first.
            values.append(fill.shaped(sums.agg(mean_of(F.sum(total), F.sum(count))).scalar()))
        updates[name] = F.coalesce(*values, F.lit(fill.default).cast(fill.type_name))
    return filled.withColumns(updates).select(restaurants.columns)


def fill_rating(restaurants: DataFrame) -> DataFrame:
    return fill_means(restaurants, ["rating"])


def fill_delivery_time(restaurants: DataFrame) -> DataFrame:
    return fill_means(restaurants, ["delivery_time"])


def fill_delivery_fee(restaurants: DataFrame) -> DataFrame:
    return fill_means(restaurants, ["delivery_fee"])


def fill_min_order(restaurants: DataFrame) -> DataFrame:
    return fill_means(restaurants, ["min_order"])


# Fixed values: (rating from, rating subtracted, factor, addend), best band first,
# and the review count of a restaurant without a rating.
REVIEW_BANDS = [("4.5", "3.0", 200, 50), ("4.0", "3.0", 150, 30), ("3.5", "3.0", 100, 20)]
LOWEST_REVIEWS = ("2.0", 50, 10)
UNRATED_REVIEWS = 25


def fill_reviews(restaurants: DataFrame) -> DataFrame:
    """Estimate missing review counts from the rating, in decimal arithmetic."""
    rating = F.col("rating")

    def tenths(text: str) -> Column:
        return F.lit(text).cast("decimal(2,1)")

    def line(base: str, factor: int, addend: int) -> Column:
        return ((rating - tenths(base)) * factor + addend).cast("int")

    estimate = F.when(rating.isNull(), F.lit(UNRATED_REVIEWS))
    for lower, base, factor, addend in REVIEW_BANDS:
        estimate = estimate.when(rating >= tenths(lower), line(base, factor, addend))
    estimate = estimate.otherwise(line(*LOWEST_REVIEWS))
    return restaurants.withColumn("reviews", F.coalesce("reviews", estimate))


def fill_all(restaurants: DataFrame) -> DataFrame:
    """All columns at once; review counts see the ratings filled before them."""
    return fill_reviews(fill_means(restaurants, list(FILLS)))
