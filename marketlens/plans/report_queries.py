"""Reports and joins as queries."""

from marketlens.operators import joins, reports
from marketlens.plans.registry import query


@query(
    "r1_top_rated",
    "SELECT name, category, rating, city, delivery_fee FROM {restaurants} WHERE rating IS NOT NULL ORDER BY rating DESC, name, id LIMIT 10",
)
def _(t):
    return reports.top_rated(t.restaurants)


@query(
    "r2_category_summary",
    """SELECT category, COUNT(*) AS total, AVG(rating) AS avg_rating, MIN(delivery_fee) AS min_delivery, MAX(delivery_fee) AS max_delivery
FROM {restaurants} GROUP BY category""",
)
def _(t):
    return reports.category_summary(t.restaurants)


@query(
    "r3_priciest",
    "SELECT restaurant_name, name, category, price FROM {products} WHERE price IS NOT NULL ORDER BY price DESC, id LIMIT 20",
)
def _(t):
    return reports.priciest(t.products)


@query(
    "r4_delivery_stats",
    """SELECT COUNT(*) AS total_restaurants, COUNT(CASE WHEN delivery_fee = 0 THEN 1 END) AS free_delivery,
 ROUND(AVG(delivery_fee), 2) AS avg_delivery_fee, MIN(delivery_fee) AS min_fee, MAX(delivery_fee) AS max_fee
FROM {restaurants} WHERE delivery_fee IS NOT NULL""",
)
def _(t):
    return reports.delivery_stats(t.restaurants)


@query(
    "r5_price_by_category",
    """SELECT category, COUNT(*) AS total_products, ROUND(AVG(price), 2) AS avg_price, MIN(price) AS min_price, MAX(price) AS max_price
FROM {products} WHERE price IS NOT NULL GROUP BY category""",
)
def _(t):
    return reports.price_by_category(t.products)


@query(
    "r6_without_products",
    """SELECT name, category, city, rating FROM {restaurants} r
WHERE NOT EXISTS (SELECT 1 FROM {products} p WHERE p.restaurant_id = r.id)""",
)
def _(t):
    return reports.without_products(t.restaurants, t.products)


@query(
    "r7_totals",
    """SELECT 'Restaurantes' AS item, COUNT(*) AS total FROM {restaurants} UNION ALL SELECT 'Produtos', COUNT(*) FROM {products}
UNION ALL SELECT 'Categorias', COUNT(*) FROM {categories}""",
)
def _(t):
    return reports.totals({"Restaurantes": t.restaurants, "Produtos": t.products, "Categorias": t.categories})


# The labels stand in the operator's module, marked as fixed.
BANDS = " ".join(f"WHEN rating >= {lower} THEN '{label}'" for lower, label in reports.RATING_BANDS)


@query(
    "r8_rating_bands",
    f"""SELECT CASE {BANDS} ELSE '{reports.LOWEST_BAND}' END AS rating_category, COUNT(*) AS total_restaurants,
 ROUND(AVG(rating), 2) AS avg_rating FROM {{restaurants}} WHERE rating IS NOT NULL GROUP BY 1""",
)
def _(t):
    return reports.rating_bands(t.restaurants)


@query("r9_category_counts", "SELECT category, COUNT(*) AS total FROM {restaurants} GROUP BY category")
def _(t):
    return reports.category_counts(t.restaurants)


@query(
    "r9_rating_stats",
    "SELECT AVG(rating) AS avg_rating, MIN(rating) AS min_rating, MAX(rating) AS max_rating FROM {restaurants} WHERE rating IS NOT NULL",
)
def _(t):
    return reports.rating_stats(t.restaurants)


@query(
    "r9_priciest_ten",
    "SELECT restaurant_name, name, category, price FROM {products} WHERE price IS NOT NULL ORDER BY price DESC, id LIMIT 10",
)
def _(t):
    return reports.priciest(t.products, 10)


@query(
    "r10_collected_by_category",
    "SELECT categoria, COUNT(*) AS collected FROM {staging} GROUP BY categoria",
)
def _(t):
    return reports.collected_counts(t.staging, "categoria")


@query(
    "r10_collected_by_restaurant",
    "SELECT restaurant_id, COUNT(*) AS collected FROM {product_staging} GROUP BY restaurant_id",
)
def _(t):
    return reports.collected_counts(t.product_staging, "restaurant_id")


@query(
    "j1_menu_size",
    """SELECT r.name AS restaurant, r.category, r.rating, COUNT(p.id) AS total_products, ROUND(AVG(p.price), 2) AS avg_product_price
FROM {restaurants} r LEFT JOIN {products} p ON p.restaurant_id = r.id GROUP BY r.id, r.name, r.category, r.rating
ORDER BY total_products DESC, r.rating DESC NULLS LAST, r.id LIMIT 20""",
)
def _(t):
    return joins.menu_size(t.restaurants, t.products)


TOP_ITEMS = """SELECT restaurant, category, product, price, description FROM
(SELECT r.name AS restaurant, r.category, p.name AS product, p.price, p.description, p.id,
 RANK() OVER (PARTITION BY r.id ORDER BY p.price DESC) AS place
 FROM {products} p JOIN {restaurants} r ON p.restaurant_id = r.id WHERE p.price IS NOT NULL) x WHERE place = 1"""


@query("j2_top_item_per_restaurant", f"{TOP_ITEMS} ORDER BY price DESC, id LIMIT 15")
def _(t):
    return joins.top_item_per_restaurant(t.restaurants, t.products)


@query("j2_top_items_all", TOP_ITEMS)
def _(t):
    return joins.top_items(t.restaurants, t.products).select("restaurant", "category", "product", "price", "description")


@query(
    "j3_menu",
    """SELECT category, name, description, price FROM {products}
WHERE restaurant_id = 30 AND EXISTS (SELECT 1 FROM {restaurants} WHERE id = 30)""",
)
def _(t):
    return joins.menu(t.restaurants, t.products, 30)


@query(
    "j4_with_products",
    """SELECT r.id, r.name, c.product_count FROM {restaurants} r
JOIN (SELECT restaurant_id, COUNT(*) AS product_count FROM {products} GROUP BY restaurant_id) c ON c.restaurant_id = r.id
ORDER BY r.name, r.id LIMIT 20""",
)
def _(t):
    return joins.with_products(t.restaurants, t.products)


@query(
    "j5_category_analysis",
    """SELECT r.category AS restaurant_category, COUNT(DISTINCT r.id) AS total_restaurants, COUNT(p.id) AS total_products,
 ROUND(AVG(p.price), 2) AS avg_product_price, ROUND(AVG(r.rating), 2) AS avg_restaurant_rating
FROM {restaurants} r LEFT JOIN {products} p ON p.restaurant_id = r.id GROUP BY r.category""",
)
def _(t):
    return joins.category_analysis(t.restaurants, t.products)


@query(
    "j6_price_matrix",
    """SELECT r.category AS restaurant_category, p.category AS product_category, COUNT(*) AS product_count,
 MIN(p.price) AS min_price, ROUND(AVG(p.price), 2) AS avg_price, MAX(p.price) AS max_price
FROM {products} p JOIN {restaurants} r ON p.restaurant_id = r.id WHERE p.price IS NOT NULL GROUP BY r.category, p.category""",
)
def _(t):
    return joins.price_matrix(t.restaurants, t.products)


@query(
    "j7_missing_descriptions",
    """SELECT r.name AS restaurant, r.category, COUNT(*) AS products_without_description
FROM {products} p JOIN {restaurants} r ON p.restaurant_id = r.id WHERE p.description IS NULL OR p.description = ''
GROUP BY r.id, r.name, r.category ORDER BY products_without_description DESC, r.id LIMIT 15""",
)
def _(t):
    return joins.missing_descriptions(t.restaurants, t.products)


@query(
    "j8_reference_count",
    "SELECT COUNT(*) AS \"references\" FROM {products_dirty} WHERE restaurant_id IN (SELECT id FROM {restaurants})",
)
def _(t):
    return joins.reference_count(t.products_dirty, "restaurant_id", t.restaurants)


@query(
    "j9_orphans",
    "SELECT * FROM {products_dirty} WHERE restaurant_id NOT IN (SELECT id FROM {restaurants})",
)
def _(t):
    return joins.orphans(t.products_dirty, "restaurant_id", t.restaurants)
