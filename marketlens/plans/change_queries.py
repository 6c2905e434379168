"""Row changes, retention and schema evolution as queries."""

from pyspark.sql import functions as F

from marketlens.operators import changes, evolution, stats
from marketlens.plans.derived import AS_OF
from marketlens.plans.registry import query
from marketlens.schemas import base_schemas, conform, table_def, template

DISH_ROWS = table_def(
    [
        ("id", "BIGINT", False, True),
        ("name", "VARCHAR", False, False),
        ("restaurant_id", "BIGINT", True, False),
        ("price", "DECIMAL", True, False),
        ("available", "BOOLEAN", True, False),
        ("valid_until", "DATE", True, False),
    ]
)
FITS = r"""name IS NOT NULL AND regexp_matches(restaurant_id, '^[+-]?\d+$')
 AND (price IS NULL OR regexp_matches(price, '^[+-]?(\d+(\.\d*)?|\.\d+)$'))
 AND lower(available) IN ('true', 'false', '1', '0', 'sim', 'não', 's', 'n') AND length(valid_until) = 10
 AND valid_until LIKE '____-__-__'"""
EXISTING_DISHES = """SELECT id, name, restaurant_id, price, id % 2 = 0 AS available, CAST(scraped_at AS DATE) AS valid_until FROM {products}"""


def _dishes(t):
    return t.products.select(
        "id",
        "name",
        "restaurant_id",
        "price",
        (F.col("id") % 2 == 0).alias("available"),
        F.col("scraped_at").cast("date").alias("valid_until"),
    )


def _inserted(t):
    return changes.insert(_dishes(t), t.typed_in, DISH_ROWS, "pos")


@query(
    "m1_insert",
    f"""{EXISTING_DISHES} UNION ALL SELECT row_number() OVER (ORDER BY pos) + (SELECT MAX(id) FROM {{products}}), name,
 CAST(restaurant_id AS BIGINT), CAST(price AS DECIMAL(10,2)), lower(available) IN ('true', '1', 'sim', 's'), CAST(valid_until AS DATE)
FROM (SELECT * FROM {{typed_in}} WHERE {FITS}) v""",
)
def _(t):
    return _inserted(t)[0]


@query("m1_rejected", f"SELECT * FROM {{typed_in}} WHERE NOT coalesce({FITS}, false)")
def _(t):
    return _inserted(t)[1]


@query(
    "m2_update_by_id",
    "SELECT * REPLACE (CASE WHEN id = 7 THEN 'Nova Loja' ELSE name END AS name, CASE WHEN id = 7 THEN CAST(4.9 AS DECIMAL(2,1)) ELSE rating END AS rating) FROM {restaurants}",
)
def _(t):
    return changes.update_by_id(t.restaurants, 7, {"name": "Nova Loja", "rating": "4.9"})


@query(
    "m3_update_where",
    "SELECT * REPLACE (CASE WHEN category = 'BUILDING' THEN CAST(3.25 AS DECIMAL(10,2)) ELSE delivery_fee END AS delivery_fee) FROM {restaurants}",
)
def _(t):
    return changes.update_where(t.restaurants, "category", "BUILDING", {"delivery_fee": "3.25"})[0]


@query("m3_affected", "SELECT COUNT(*) AS affected FROM {restaurants} WHERE category = 'BUILDING'")
def _(t):
    return changes.update_where(t.restaurants, "category", "BUILDING", {"delivery_fee": "3.25"})[1]


@query("m4_update_all", "SELECT * REPLACE ('Birigui' AS city, CAST(30 AS INT) AS delivery_time) FROM {restaurants}")
def _(t):
    return changes.update_all(t.restaurants, {"city": "Birigui", "delivery_time": 30})


@query(
    "m5_patch",
    """SELECT r.* REPLACE (COALESCE(u.reviews, r.reviews) AS reviews, COALESCE(u.min_order, r.min_order) AS min_order)
FROM {restaurants} r LEFT JOIN {extra_info} u ON r.id = u.id""",
)
def _(t):
    return changes.patch(t.restaurants, t.extra_info)


@query("m5_affected", "SELECT COUNT(*) AS affected FROM {restaurants} WHERE id IN (SELECT id FROM {extra_info})")
def _(t):
    return changes.affected_by_patch(t.restaurants, t.extra_info)


@query("m6_delete_by_id", "SELECT * FROM {restaurants} WHERE id != 7")
def _(t):
    return changes.delete_by_id(t.restaurants, 7)


@query("m7_delete_where", "SELECT * FROM {products} WHERE description != '' OR description IS NULL")
def _(t):
    return changes.delete_where(t.products, "description", "")[0]


@query("m7_affected", "SELECT COUNT(*) AS affected FROM {products} WHERE description = ''")
def _(t):
    return changes.delete_where(t.products, "description", "")[1]


@query("m8_delete_all", "SELECT * FROM {restaurants} WHERE false")
def _(t):
    return changes.delete_all(t.restaurants)


def _referring(t):
    return {
        "restaurants": t.restaurants,
        "products": t.products_dirty,
        "dishes": t.product_staging.select("pos", "restaurant_id", "nome"),
        "visits": t.history.select("id", F.col("result_count").alias("last_restaurant_id")),
        "categories": t.categories,
    }


@query(
    "m9_dependencies",
    " UNION ALL ".join(
        f"""SELECT '{table}' AS "table", '{shown}' AS "column", COUNT(*) AS count FROM {{{source}}} WHERE {column} IN (SELECT id FROM {{restaurants}})"""
        for table, shown, source, column in [
            ("products", "restaurant_id", "products_dirty", "restaurant_id"),
            ("dishes", "restaurant_id", "product_staging", "restaurant_id"),
            ("visits", "last_restaurant_id", "history", "result_count"),
        ]
    ),
)
def _(t):
    return changes.dependencies(_referring(t), "restaurants")


def _cascaded(t):
    return changes.delete_cascade(_referring(t), "restaurants", t.restaurants.where("rating IS NULL"))


@query(
    "m10_cascade_children",
    """SELECT * FROM {products_dirty} WHERE restaurant_id IS NULL
 OR restaurant_id NOT IN (SELECT id FROM {restaurants} WHERE rating IS NULL)""",
)
def _(t):
    return _cascaded(t)["products"]


@query("m10_cascade_parent", "SELECT * FROM {restaurants} WHERE rating IS NOT NULL")
def _(t):
    return _cascaded(t)["restaurants"]


@query(
    "m10_affected",
    """SELECT 'restaurants' AS "table", COUNT(*) AS affected FROM {restaurants} WHERE rating IS NULL UNION ALL
SELECT 'products', COUNT(*) FROM {products_dirty} WHERE restaurant_id IN (SELECT id FROM {restaurants} WHERE rating IS NULL)""",
)
def _(t):
    tables = {"restaurants": t.restaurants, "products": t.products_dirty}
    return changes.affected_by_cascade(tables, "restaurants", t.restaurants.where("rating IS NULL"))


@query(
    "m11_affected",
    "SELECT COUNT(*) AS affected FROM {products} WHERE scraped_at < CAST('2001-07-01 00:00:00' AS TIMESTAMP) - INTERVAL 30 DAY",
)
def _(t):
    return changes.affected_by_retention(t.products, "2001-07-01 00:00:00")


@query(
    "m12_affected",
    "SELECT COUNT(*) AS affected FROM {products_dirty} WHERE restaurant_id NOT IN (SELECT id FROM {restaurants})",
)
def _(t):
    return changes.affected_by_orphans(t.products_dirty, "restaurant_id", t.restaurants)


@query(
    "m11_retain",
    "SELECT * FROM {products} WHERE scraped_at >= CAST('2001-07-01 00:00:00' AS TIMESTAMP) - INTERVAL 30 DAY OR scraped_at IS NULL",
)
def _(t):
    return changes.retain(t.products, "2001-07-01 00:00:00")


@query(
    "m12_drop_orphans",
    "SELECT * FROM {products_dirty} WHERE restaurant_id IS NULL OR restaurant_id IN (SELECT id FROM {restaurants})",
)
def _(t):
    return changes.drop_orphans(t.products_dirty, "restaurant_id", t.restaurants)


# --- schema evolution -------------------------------------------------------

PART_TABLE = table_def(
    [
        ("p_partkey", "BIGINT", False, True),
        ("p_name", "VARCHAR(255)", False, False),
        ("p_retailprice", "DECIMAL(10,2)", True, False),
        ("p_size", "TEXT", True, False),
        ("in_stock", "BOOLEAN", True, False, "true"),
        ("listed_on", "DATE", True, False),
    ]
)


@query(
    "d1_table_def",
    """SELECT p_partkey, p_name, CAST(p_retailprice AS DECIMAL(10,2)) AS p_retailprice,
 CAST(p_size AS VARCHAR) AS p_size, true AS in_stock, CAST(NULL AS DATE) AS listed_on FROM part""",
)
def _(t):
    return conform(t.part, PART_TABLE)


@query(
    "d2_template",
    f"""SELECT o_orderkey AS id, o_custkey AS usuario_id, CAST(o_totalprice AS DECIMAL(10,2)) AS total,
 'pendente' AS status, CAST(NULL AS VARCHAR) AS endereco_entrega, CAST('{AS_OF}' AS TIMESTAMP) AS data_pedido FROM orders""",
)
def _(t):
    _, schema = template("pedidos", "encomendas")
    rows = t.orders.selectExpr("o_orderkey AS id", "o_custkey AS usuario_id", "o_totalprice AS total")
    return conform(rows, schema, AS_OF)


@query(
    "d3_base_schemas",
    """SELECT id, restaurant_id, name, description, price, category, true AS available
FROM {products}""",
)
def _(t):
    return conform(t.products, base_schemas()["dishes"])


@query(
    "d4_add_missing",
    "SELECT *, CAST(NULL AS TIMESTAMP) AS updated_at, CAST(NULL AS VARCHAR) AS link FROM {products}",
)
def _(t):
    return evolution.add_missing(t.products, {"updated_at": "timestamp", "link": "string", "price": "decimal(10,2)"})


@query("d5_current_version", "SELECT version FROM {ledger} ORDER BY applied_at DESC, id DESC LIMIT 1")
def _(t):
    return evolution.current_version(t.ledger)


@query("d5_pending", "SELECT * FROM {migrations} WHERE version NOT IN (SELECT version FROM {ledger})")
def _(t):
    return evolution.pending(t.migrations, t.ledger)


@query(
    "d5_record",
    f"""SELECT id, version, description, applied_at, checksum FROM {{ledger}} UNION ALL
SELECT row_number() OVER (ORDER BY version) + (SELECT MAX(id) FROM {{ledger}}), version, description, CAST('{AS_OF}' AS TIMESTAMP), md5(text)
FROM {{migrations}} WHERE version NOT IN (SELECT version FROM {{ledger}})""",
)
def _(t):
    return evolution.record(t.ledger, evolution.pending(t.migrations, t.ledger), AS_OF)


@query(
    "d6_drop_table",
    """SELECT 'categories' AS "table", 4 AS columns, COUNT(*) AS rows FROM {categories}
UNION ALL SELECT 'restaurants', 11, COUNT(*) FROM {restaurants}""",
)
def _(t):
    tables = {"categories": t.categories, "products": t.products, "restaurants": t.restaurants}
    return stats.catalog_summary(evolution.drop_table(tables, "products"))


@query(
    "d7_fk_violations",
    "SELECT * FROM {products_dirty} p WHERE restaurant_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {restaurants} r WHERE r.id = p.restaurant_id)",
)
def _(t):
    rule = evolution.fk("products", "restaurant_id", "restaurants")
    return rule.violations({"products": t.products_dirty, "restaurants": t.restaurants})
