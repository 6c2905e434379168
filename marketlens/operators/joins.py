"""Reports over restaurants and their products.

Products are summed up per restaurant before they are joined: partial sums are
formed in the map tasks, so a restaurant owning a large part of all products
reaches the join as one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.numeric import mean_of, round_half_up
from marketlens.operators.lookup import lookup_join

MONEY = "decimal(10,2)"


def _per_restaurant(products: DataFrame, *more: str) -> DataFrame:
    price = F.col("price")
    return (
        products.where(F.col("restaurant_id").isNotNull())
        .groupBy("restaurant_id", *more)
        .agg(
            F.count("id").alias("n_products"),
            F.count(price).alias("n_priced"),
            F.sum(price).alias("price_sum"),
            F.min(price).alias("price_min"),
            F.max(price).alias("price_max"),
        )
    )


def menu_size(restaurants: DataFrame, products: DataFrame, n: int = 20) -> DataFrame:
    """Number and mean price of each restaurant's products, largest menus first."""
    menus = _per_restaurant(products)
    joined = restaurants.join(menus, restaurants["id"] == menus["restaurant_id"], "left")
    return (
        joined.select(
            "id",
            F.col("name").alias("restaurant"),
            "category",
            "rating",
            F.coalesce("n_products", F.lit(0)).alias("total_products"),
            round_half_up(mean_of(F.col("price_sum"), F.col("n_priced")), 2).alias("avg_product_price"),
        )
        .orderBy(F.desc("total_products"), F.desc_nulls_last("rating"), "id")
        .limit(n)
        .drop("id")
    )


def top_items(restaurants: DataFrame, products: DataFrame) -> DataFrame:
    """The most expensive product of every restaurant, all of them where prices tie.

    Ranks are limited in the map tasks first, so the products of one restaurant do not gather,
    and only the survivors meet the restaurants.
    """
    priced = products.where(F.col("price").isNotNull() & F.col("restaurant_id").isNotNull())
    rank = F.rank().over(Window.partitionBy("restaurant_id").orderBy(F.desc("price")))
    owners = restaurants.select(
        F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant"), F.col("category")
    )
    items = priced.select("id", "restaurant_id", "price", F.col("name").alias("product"), "description")
    return items.withColumn("_rank", rank).where("_rank = 1").drop("_rank").join(owners, "restaurant_id")


def top_item_per_restaurant(restaurants: DataFrame, products: DataFrame, n: int = 15) -> DataFrame:
    return (
        top_items(restaurants, products)
        .orderBy(F.desc("price"), "id")
        .limit(n)
        .select("restaurant", "category", "product", "price", "description")
    )


def menu(restaurants: DataFrame, products: DataFrame, restaurant_id: int) -> DataFrame:
    """One restaurant's products; empty if there is no such restaurant."""
    owner = restaurants.where(F.col("id") == restaurant_id).select(F.col("id").alias("restaurant_id"))
    return (
        products.where(F.col("restaurant_id") == restaurant_id)
        .join(owner, "restaurant_id", "left_semi")
        .orderBy(F.asc_nulls_last("category"), F.desc_nulls_last("price"), "id")
        .select("category", "name", "description", "price")
    )


def with_products(restaurants: DataFrame, products: DataFrame, n: int = 20) -> DataFrame:
    """Restaurants that have products, by name."""
    counts = products.groupBy(F.col("restaurant_id").alias("id")).agg(F.count("id").alias("product_count"))
    return (
        restaurants.join(counts.where("product_count > 0"), "id")
        .orderBy(F.asc_nulls_last("name"), "id")
        .limit(n)
        .select("id", "name", "product_count")
    )


def category_analysis(restaurants: DataFrame, products: DataFrame) -> DataFrame:
    """Restaurants, products, mean price and rating per restaurant category.

    The mean rating counts a restaurant once per product (once if it has none),
    as averaging over the joined rows does.
    """
    menus = _per_restaurant(products)
    weight = F.greatest(F.coalesce("n_products", F.lit(0)), F.lit(1))
    rated = F.when(F.col("rating").isNotNull(), weight)
    joined = restaurants.join(menus, restaurants["id"] == menus["restaurant_id"], "left")
    return (
        joined.groupBy(F.col("category").alias("restaurant_category"))
        .agg(
            # One row per restaurant here, so counting rows counts distinct ids.
            F.count("id").alias("total_restaurants"),
            F.coalesce(F.sum("n_products"), F.lit(0)).alias("total_products"),
            round_half_up(mean_of(F.sum("price_sum"), F.sum("n_priced")), 2).alias("avg_product_price"),
            round_half_up(mean_of(F.sum(F.col("rating") * rated), F.sum(rated)), 2).alias("avg_restaurant_rating"),
        )
        .orderBy(F.desc("total_products"), F.asc_nulls_last("restaurant_category"))
    )


def price_matrix(restaurants: DataFrame, products: DataFrame) -> DataFrame:
    """Prices per restaurant category and product category."""
    menus = _per_restaurant(products.where(F.col("price").isNotNull()), "category").withColumnRenamed(
        "category", "product_category"
    )
    owners = restaurants.select(F.col("id").alias("restaurant_id"), F.col("category").alias("restaurant_category"))
    return (
        menus.join(owners, "restaurant_id")
        .groupBy("restaurant_category", "product_category")
        .agg(
            F.sum("n_products").alias("product_count"),
            F.min("price_min").cast(MONEY).alias("min_price"),
            round_half_up(mean_of(F.sum("price_sum"), F.sum("n_priced")), 2).alias("avg_price"),
            F.max("price_max").cast(MONEY).alias("max_price"),
        )
        .orderBy(F.asc_nulls_last("restaurant_category"), F.desc("avg_price"), F.asc_nulls_last("product_category"))
    )


def missing_descriptions(restaurants: DataFrame, products: DataFrame, n: int = 15) -> DataFrame:
    """Restaurants with most products lacking a description."""
    lacking = (
        products.where(F.col("description").isNull() | (F.col("description") == ""))
        .groupBy(F.col("restaurant_id").alias("id"))
        .agg(F.count("id").alias("products_without_description"))
    )
    return (
        restaurants.join(lacking, "id")
        .orderBy(F.desc("products_without_description"), "id")
        .limit(n)
        .select(F.col("name").alias("restaurant"), "category", "products_without_description")
    )


def reference_count(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """How many child rows refer to an existing parent row."""
    per_key = child.groupBy(F.col(column).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    parents = parent.select(F.col(key).alias("_key"))
    return per_key.join(parents, "_key", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("references"))


def orphan_keys(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Distinct keys of the child that have no parent row, as ``column``."""
    used = child.where(F.col(column).isNotNull()).select(column).distinct()
    return used.join(parent.select(F.col(key).alias(column)), column, "left_anti")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Child rows whose key is set but has no parent row.

    Only distinct keys are compared with the parent; the orphan keys, normally few,
    then select the rows.
    """
    return lookup_join(child, orphan_keys(child, column, parent, key), column, how="left_semi")
