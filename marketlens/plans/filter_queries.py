"""Filters, searches and pages as queries."""

from marketlens.operators import filters, paging
from marketlens.plans.registry import query

LISTING = "SELECT id, name, category, link FROM {restaurants}"
VALID_LINK = "link IS NOT NULL AND link != 'N/A'"


@query("f1_contains", "SELECT * FROM {products} WHERE name LIKE '%ring 1%'")
def _(t):
    return filters.contains(t.products, "name", "ring 1")


@query("f1_contains_wildcard", "SELECT * FROM {restaurants} WHERE name LIKE '%1_3%'")
def _(t):
    return filters.contains(t.restaurants, "name", "1_3")


@query("f2_equals_number", "SELECT * FROM {restaurants} WHERE rating = 4.5")
def _(t):
    return filters.equals(t.restaurants, "rating", "4.5")


@query("f2_equals_text", "SELECT * FROM {restaurants} WHERE category = 'FURNITURE'")
def _(t):
    return filters.equals(t.restaurants, "category", "FURNITURE")


@query("f3_greater", "SELECT * FROM {products} WHERE price > 250000")
def _(t):
    return filters.greater(t.products, "price", 250000)


@query("f4_less", "SELECT * FROM {products} WHERE price < 50000")
def _(t):
    return filters.less(t.products, "price", 50000)


@query("f5_between", "SELECT * FROM {restaurants} WHERE delivery_fee BETWEEN 2.00 AND 7.50")
def _(t):
    return filters.between(t.restaurants, "delivery_fee", "2.00", "7.50")


@query("f6_is_null", "SELECT * FROM {restaurants} WHERE delivery_time IS NULL")
def _(t):
    return filters.is_null(t.restaurants, "delivery_time")


@query("f7_not_null", "SELECT * FROM {products} WHERE description IS NOT NULL")
def _(t):
    return filters.not_null(t.products, "description")


@query("f8_in_range", "SELECT * FROM {restaurants} WHERE rating >= 3.0 AND rating <= 4.0")
def _(t):
    return filters.in_range(t.restaurants, "rating", "3.0", "4.0")


@query("f8_in_range_open", "SELECT * FROM {restaurants} WHERE reviews <= 120")
def _(t):
    return filters.in_range(t.restaurants, "reviews", high=120)


@query(
    "f9_in_dates",
    "SELECT * FROM {history} WHERE ts >= CAST('2024-01-10' AS TIMESTAMP) AND ts <= CAST('2024-01-20' AS TIMESTAMP)",
)
def _(t):
    return filters.in_dates(t.history, "ts", "2024-01-10", "2024-01-20")


@query("f10_where", "SELECT * FROM {restaurants} WHERE rating >= 4 AND (delivery_fee = 0 OR min_order < 20)")
def _(t):
    return filters.where(t.restaurants, "rating >= 4 AND (delivery_fee = 0 OR min_order < 20)")


@query("f11_by_id", "SELECT * FROM {products} WHERE id = 42")
def _(t):
    return filters.by_id(t.products, 42)


@query("f12_value_counts", "SELECT rating AS value, COUNT(*) AS quantidade FROM {restaurants} GROUP BY rating")
def _(t):
    return filters.value_counts(t.restaurants, "rating")


@query("f12_value_counts_text", "SELECT name AS value, COUNT(*) AS quantidade FROM {restaurants_dirty} GROUP BY name")
def _(t):
    return filters.value_counts(t.restaurants_dirty, "name")


@query("f13_preview", "SELECT * FROM {products} WHERE description = '' ORDER BY id LIMIT 50")
def _(t):
    return filters.preview(filters.equals(t.products, "description", ""))


@query(
    "f15_needs_extra_info",
    f"{LISTING} WHERE (reviews IS NULL OR min_order IS NULL) AND {VALID_LINK}",
)
def _(t):
    return filters.needs_extra_info(t.restaurants)


@query("f16_with_link", f"{LISTING} WHERE {VALID_LINK}")
def _(t):
    return filters.with_link(t.restaurants)


@query("f16_with_link_category", f"{LISTING} WHERE category = 'MACHINERY' AND {VALID_LINK}")
def _(t):
    return filters.with_link(t.restaurants, "MACHINERY")


@query(
    "f17_categories_with_link",
    f"SELECT category, COUNT(*) AS count FROM {{restaurants}} WHERE {VALID_LINK} GROUP BY category",
)
def _(t):
    return filters.categories_with_link(t.restaurants)


@query("f18_restaurant_targets", LISTING)
def _(t):
    return filters.restaurant_targets(t.restaurants)


@query(
    "f19_restaurants_by_category",
    """SELECT category, part, COUNT(*) AS n, string_agg(concat(CAST(id AS VARCHAR), '=', name), ',' ORDER BY place) AS listed
FROM (SELECT category, id, name, place, CAST(place // 1000 AS INT) AS part
 FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY name, id) - 1 AS place FROM {restaurants}) x) y
GROUP BY category, part""",
)
def _(t):
    lists = filters.restaurants_by_category(t.restaurants)
    return lists.selectExpr(
        "category",
        "part",
        "CAST(size(restaurants) AS BIGINT) AS n",
        "array_join(transform(restaurants, r -> concat(CAST(r.id AS STRING), '=', r.name)), ',') AS listed",
    )


@query("f20_category_targets", "SELECT categorias, links FROM {categories_dirty}")
def _(t):
    return filters.category_targets(t.categories_dirty)


@query("p1_page", "SELECT * FROM {products} WHERE price > 100000 ORDER BY id LIMIT 20 OFFSET 40")
def _(t):
    return paging.page(t.products, 3, 20, "price > 100000")


@query(
    "p1_page_count",
    "SELECT COUNT(*) AS total, CAST(ceil(COUNT(*) / 20.0) AS BIGINT) AS pages FROM {products} WHERE price > 100000",
)
def _(t):
    return paging.page_count(t.products, 20, "price > 100000")


@query("p2_page_latest", "SELECT * FROM {products} ORDER BY id DESC LIMIT 20 OFFSET 20")
def _(t):
    return paging.page_latest(t.products, 2)


@query("p3_page_ordered", "SELECT * FROM {restaurants} ORDER BY rating DESC NULLS LAST, id LIMIT 50 OFFSET 50")
def _(t):
    return paging.page_ordered(t.restaurants, 2, 50, "rating", "desc")


@query("p3_page_after", "SELECT * FROM {products} WHERE id > 777 ORDER BY id LIMIT 20")
def _(t):
    return paging.page_after(t.products, 777)


@query("p4_latest", "SELECT * FROM {restaurants} ORDER BY id DESC LIMIT 10")
def _(t):
    return paging.latest(t.restaurants)


@query("p5_sample_rows", "SELECT * FROM {restaurants} WHERE category = 'AUTOMOBILE' ORDER BY id LIMIT 15")
def _(t):
    return paging.sample_rows(filters.equals(t.restaurants, "category", "AUTOMOBILE"), 15)
