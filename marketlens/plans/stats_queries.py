"""Catalogue and column statistics as queries."""

from pyspark.sql import functions as F

from marketlens.operators import properties, stats
from marketlens.plans.derived import AS_OF, RAW
from marketlens.plans.registry import query
from marketlens.sources import sketches
from marketlens.sources.scratch import new_path

LISTED = ["categories", "products", "restaurants"]
WIDTHS = {"categories": 4, "products": 8, "restaurants": 11}


def _listed(t):
    return {name: getattr(t, name) for name in LISTED}


@query(
    "s2_catalog_summary",
    " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", (SELECT CAST(COUNT(*) AS INT) FROM (DESCRIBE {name})) AS columns, COUNT(*) AS rows FROM {name}"
        for name in RAW
    ),
)
def _(t):
    return stats.catalog_summary({name: getattr(t, name) for name in RAW})


RESTAURANT_TYPES = {
    "id": "bigint", "name": "string", "category": "string", "rating": "decimal(2,1)", "delivery_time": "int",
    "delivery_fee": "decimal(10,2)", "city": "string", "link": "string", "reviews": "int",
    "min_order": "decimal(10,2)", "scraped_at": "timestamp",
}


@query(
    "s3_describe",
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS \"column\", '{kind}' AS type, COUNT(*) FILTER ({name} IS NULL) AS nulls FROM {{restaurants}}"
        for i, (name, kind) in enumerate(RESTAURANT_TYPES.items(), 1)
    ),
)
def _(t):
    return stats.describe(t.restaurants).select("position", "column", "type", "nulls")


@query(
    "t1_numeric_profile",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", CAST(MIN({name}) AS DOUBLE) AS min, CAST(MAX({name}) AS DOUBLE) AS max,
 AVG({name}) AS avg, COUNT(DISTINCT {name}) AS "distinct", CAST(MIN({name}) AS VARCHAR) AS min_value, CAST(MAX({name}) AS VARCHAR) AS max_value FROM {{restaurants}} WHERE {name} IS NOT NULL"""
        for name in ["id", "rating", "delivery_time", "delivery_fee", "reviews", "min_order"]
    ),
)
def _(t):
    return stats.numeric_profile(t.restaurants)


@query(
    "t2_text_profile",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", COUNT(DISTINCT {name}) AS "distinct", COUNT(*) AS total,
 COUNT(CASE WHEN {name} IS NULL OR {name} = '' THEN 1 END) AS null_empty,
 CAST(COUNT(*) - COUNT(CASE WHEN {name} IS NULL OR {name} = '' THEN 1 END) AS DOUBLE) / COUNT(*) * 100 AS completeness FROM {{products}}"""
        for name in ["restaurant_name", "category", "name", "description"]
    ),
)
def _(t):
    return stats.text_profile(t.products)


@query(
    "t3_common_values",
    """SELECT category AS value, COUNT(*) AS count FROM {restaurants} WHERE category IS NOT NULL AND category != ''
 AND (SELECT COUNT(DISTINCT category) FROM {restaurants}) <= 20 GROUP BY category ORDER BY count DESC, value LIMIT 5""",
)
def _(t):
    return stats.common_values(t.restaurants, "category")


@query(
    "t3_common_values_city",
    """SELECT city AS value, COUNT(*) AS count FROM {restaurants} WHERE city IS NOT NULL AND city != ''
 AND (SELECT COUNT(DISTINCT city) FROM {restaurants}) <= 30 GROUP BY city ORDER BY count DESC, value LIMIT 5""",
)
def _(t):
    return stats.common_values(t.restaurants, "city", max_distinct=30)


@query("t4_recent", f"SELECT * FROM {{history}} WHERE ts >= CAST('{AS_OF}' AS TIMESTAMP) - INTERVAL 1 DAY")
def _(t):
    return stats.recent(t.history, "ts", AS_OF)


@query(
    "t5_table_stats",
    "SELECT *, CAST(SUM(rows) OVER () AS BIGINT) AS total_rows FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS \"table\", COUNT(*) AS rows, {WIDTHS[n]} AS fields FROM {{{n}}}" for n in LISTED
    )
    + ") x",
)
def _(t):
    return stats.table_stats(_listed(t))


@query(
    "t6_restaurant_stats",
    "SELECT AVG(rating) AS avg_rating, COUNT(DISTINCT city) AS cities, COUNT(DISTINCT category) AS categories FROM {restaurants}",
)
def _(t):
    return stats.restaurant_stats(t.restaurants)


@query(
    "t7_product_stats",
    "SELECT AVG(price) AS avg_price, COUNT(DISTINCT restaurant_id) AS restaurants_with_products FROM {products}",
)
def _(t):
    return stats.product_stats(t.products)


@query(
    "t8_dashboard",
    """SELECT categories, restaurants, products, categories + restaurants + products AS total, last_collected FROM
(SELECT (SELECT COUNT(*) FROM {categories}) AS categories, (SELECT COUNT(*) FROM {restaurants}) AS restaurants,
 (SELECT COUNT(*) FROM {products}) AS products, (SELECT MAX(d) FROM (SELECT created_at AS d FROM {categories}
 UNION ALL SELECT scraped_at FROM {restaurants} UNION ALL SELECT scraped_at FROM {products}) x) AS last_collected) y""",
)
def _(t):
    return stats.dashboard(t.categories, t.restaurants, t.products)


@query(
    "t9_size_share",
    "SELECT \"table\", rows, rows * 500 AS estimated_bytes, CAST(rows AS DOUBLE) / SUM(rows) OVER () * 100 AS share FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS \"table\", COUNT(*) AS rows FROM {{{n}}}" for n in LISTED)
    + ") x",
)
def _(t):
    return stats.size_share(_listed(t))


def _exact(name: str, empty: str, low: str, high: str, mean: str) -> str:
    return f"""SELECT '{name}' AS "column", COUNT(*) AS rows, COUNT(*) FILTER ({name} IS NULL) AS nulls, {empty} AS empty,
 {low} AS min_value, {high} AS max_value, {mean} AS mean, TRUE AS distinct_ok, TRUE AS quantiles_ok FROM {{products}}"""


@query(
    "n9_stored_sketches",
    " UNION ALL ".join(
        [
            _exact(n, "CAST(NULL AS BIGINT)", f"CAST(MIN({n}) AS VARCHAR)", f"CAST(MAX({n}) AS VARCHAR)", f"AVG({n})")
            for n in ["id", "restaurant_id", "price"]
        ]
        + [
            _exact(n, f"COUNT(*) FILTER ({n} = '')", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)")
            for n in ["restaurant_name", "category", "name", "description"]
        ]
    ),
)
def _(t):
    path, store, schema = new_path(t.spark, "products"), new_path(t.spark, "sketches"), t.products.schema
    # The table arrives in two deliveries; the second refresh reads only the second one.
    cheap = F.coalesce(F.col("price") < 100_000, F.lit(False))
    for delivery in (cheap, ~cheap):
        t.products.where(delivery).write.mode("append").parquet(path)
        sketches.refresh(t.spark, path, schema, store)
    return sketches.audit(t.products, sketches.profile(t.spark, path, schema, store)).drop("distinct", "quantiles")


_OBJECTS = "(SELECT event_id, CAST(props AS JSON) AS j FROM {event_props} WHERE event_id % 50 NOT IN (7, 8)) x"


@query(
    "n10_property_types",
    f"""SELECT key, type, COUNT(*) AS rows FROM (SELECT unnest(['type', 'k', 'amount', 'seen', concat('u', user_id)]) AS key,
 unnest(['STRING', 'BIGINT', CASE WHEN event_id % 3 = 0 THEN 'BIGINT' ELSE concat('DECIMAL(', length(CAST(user_id AS VARCHAR)) + 2 - CAST(user_id = 0 AS INT), ',2)') END, CASE WHEN event_id % 4 = 0 THEN 'BOOLEAN' END, 'BIGINT']) AS type
 FROM events WHERE event_id % 50 NOT IN (7, 8)) x WHERE type IS NOT NULL GROUP BY key, type""",
)
def _(t):
    return properties.key_types(t.event_props, "props")


def _split(t):
    return properties.typed_properties(t.event_props, "props", properties.find_schema(t.event_props, "props", 0.1))


@query(
    "n11_typed_properties",
    f"""SELECT event_id, CAST(j->>'$.type' AS VARCHAR) AS type, CAST(j->>'$.k' AS BIGINT) AS k,
 CAST(CAST(j->>'$.amount' AS DECIMAL(21,2)) AS VARCHAR) AS amount, CAST(j->>'$.seen' AS BOOLEAN) AS seen,
 concat('u', user_id, '=', event_id) AS rest FROM {_OBJECTS} JOIN events USING (event_id)""",
)
def _(t):
    others = F.array_join(F.transform(F.map_entries("rest"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return _split(t)[0].select("event_id", "type", "k", F.col("amount").cast("string").alias("amount"), "seen", others.alias("rest"))


@query("n12_property_rejects", "SELECT * FROM {event_props} WHERE event_id % 50 IN (7, 8)")
def _(t):
    return _split(t)[1]
