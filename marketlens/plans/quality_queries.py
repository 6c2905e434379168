"""Quality, validation, duplicates and enrichment as queries."""

from pyspark.sql import functions as F

from marketlens.functions.checks import is_valid
from marketlens.operators import enrich, quality
from marketlens.plans.derived import AS_OF
from marketlens.plans.registry import query
from marketlens.schemas import DISHES, conform

RESTAURANT_COLUMNS = "name, category, rating, delivery_time, delivery_fee, city, link, reviews, min_order, scraped_at"
AS_OF_TS = f"CAST('{AS_OF}' AS TIMESTAMP)"


def _dirty(t):
    return {"categories": t.categories_dirty, "products": t.products_dirty, "restaurants": t.restaurants_dirty}


@query(
    "q1_duplicate_groups",
    f"SELECT {RESTAURANT_COLUMNS}, COUNT(*) AS count FROM {{restaurants_dirty}} GROUP BY {RESTAURANT_COLUMNS} HAVING COUNT(*) > 1",
)
def _(t):
    return quality.duplicate_groups(t.restaurants_dirty)


@query(
    "q1_duplicate_summary",
    f"""SELECT COUNT(*) AS groups, CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS removable FROM
(SELECT COUNT(*) AS n FROM {{restaurants_dirty}} GROUP BY {RESTAURANT_COLUMNS} HAVING COUNT(*) > 1) x""",
)
def _(t):
    return quality.duplicate_summary(t.restaurants_dirty)


@query(
    "q2_drop_exact_duplicates",
    f"SELECT * FROM {{restaurants_dirty}} WHERE id IN (SELECT MIN(id) FROM {{restaurants_dirty}} GROUP BY {RESTAURANT_COLUMNS})",
)
def _(t):
    return quality.drop_exact_duplicates(t.restaurants_dirty)


@query(
    "q3_required_missing",
    """SELECT 'name' AS "column", COUNT(*) AS n FROM {restaurants_dirty} WHERE name IS NULL OR name = ''
UNION ALL SELECT 'category', COUNT(*) FROM {restaurants_dirty} WHERE category IS NULL OR category = ''
UNION ALL SELECT 'city', COUNT(*) FROM {restaurants_dirty} WHERE city IS NULL OR city = ''
UNION ALL SELECT 'delivery_time', COUNT(*) FROM {restaurants_dirty} WHERE delivery_time IS NULL""",
)
def _(t):
    return quality.required_missing(t.restaurants_dirty, ["name", "category", "city", "delivery_time"])


@query("q4_bad_urls", "SELECT * FROM {categories_dirty} WHERE links NOT LIKE 'http%' AND links != ''")
def _(t):
    return quality.bad_urls(t.categories_dirty, "links")


@query("q5_short_names", "SELECT * FROM {categories_dirty} WHERE LENGTH(TRIM(categorias)) < 2")
def _(t):
    return quality.short_names(t.categories_dirty, "categorias")


@query("q6_out_of_range", "SELECT * FROM {restaurants_dirty} WHERE rating < 0 OR rating > 5")
def _(t):
    return quality.out_of_range(t.restaurants_dirty, "rating", 0, 5)


@query("q7_negative_fees", "SELECT * FROM {restaurants_dirty} WHERE delivery_fee IS NOT NULL AND delivery_fee < 0")
def _(t):
    return quality.negatives(t.restaurants_dirty, "delivery_fee")


@query("q7_negative_prices", "SELECT * FROM {products_dirty} WHERE price IS NOT NULL AND price < 0")
def _(t):
    return quality.negatives(t.products_dirty, "price")


@query("q8_future_rows", f"SELECT * FROM {{restaurants_dirty}} WHERE scraped_at > {AS_OF_TS}")
def _(t):
    return quality.future_rows(t.restaurants_dirty, "scraped_at", AS_OF)


@query(
    "q9_orphan_rule",
    "SELECT COUNT(*) AS orphans FROM {products_dirty} WHERE restaurant_id NOT IN (SELECT id FROM {restaurants})",
)
def _(t):
    return quality.orphan_rule(t.products_dirty, "restaurant_id", t.restaurants)


@query(
    "q10_duplicate_names",
    "SELECT COUNT(*) AS duplicates FROM (SELECT name FROM {restaurants_dirty} GROUP BY name HAVING COUNT(*) > 1) x",
)
def _(t):
    return quality.duplicate_names(t.restaurants_dirty, "name")


@query(
    "q11_duplicate_names_normalised",
    """SELECT COUNT(*) AS duplicates FROM
(SELECT LOWER(TRIM(name)) FROM {restaurants_dirty} GROUP BY LOWER(TRIM(name)) HAVING COUNT(*) > 1) x""",
)
def _(t):
    return quality.duplicate_names_normalised(t.restaurants_dirty, "name")


TEXT = {"name", "category", "city", "link", "restaurant_name", "description", "categorias", "links"}
COLUMNS = {
    "categories": ["categorias", "links", "created_at"],
    "products": ["restaurant_id", "restaurant_name", "category", "name", "description", "price", "scraped_at"],
    "restaurants": RESTAURANT_COLUMNS.split(", "),
}


def _missing(column: str) -> str:
    return f"({column} IS NULL OR {column} = '')" if column in TEXT else f"{column} IS NULL"


@query(
    "q12_null_issues",
    'SELECT "column", nulls, pct FROM ('
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT(*) FILTER ({_missing(c)}) AS nulls,
 CAST(COUNT(*) FILTER ({_missing(c)}) AS DOUBLE) / COUNT(*) * 100 AS pct FROM {{restaurants_dirty}}"""
        for c in COLUMNS["restaurants"]
    )
    + ") x WHERE pct > 10",
)
def _(t):
    return quality.null_issues(t.restaurants_dirty)


# The report's texts.
RULES = {
    "categories": [],
    "products": [("price < 0", "preços negativos")],
    "restaurants": [
        ("rating < 0 OR rating > 5", "ratings inválidos (fora de 0-5)"),
        ("delivery_fee < 0", "taxas de entrega negativas"),
    ],
}
NAMED = {"categories": "categorias", "products": "name", "restaurants": "name"}


def _report_sql(name: str) -> str:
    columns, source, named = COLUMNS[name], f"{{{name}_dirty}}", NAMED[name]
    counts = ", ".join(f"COUNT(*) FILTER ({_missing(c)}) AS n_{c}" for c in columns)
    rules = "".join(f", COUNT(*) FILTER ({sql}) AS r_{i}" for i, (sql, _) in enumerate(RULES[name]))
    shares = [f"CAST(n_{c} AS DOUBLE) / rows * 100" for c in columns]
    texts = [
        f"CASE WHEN {share} > 10 THEN concat('Campo ''{c}'': ', format('{{:.1f}}', ROUND(({share}) * 10) / 10), '% valores nulos') END"
        for c, share in zip(columns, shares)
    ]
    texts.append("CASE WHEN dups > 0 THEN concat(dups, ' possíveis duplicatas detectadas') END")
    texts += [f"CASE WHEN r_{i} > 0 THEN concat(r_{i}, ' {text}') END" for i, (_, text) in enumerate(RULES[name])]
    nulls = " + ".join(f"n_{c}" for c in columns)
    return f"""SELECT '{name}' AS "table", rows AS record_count, {nulls} AS null_fields, dups AS duplicate_records,
 list_filter([{", ".join(texts)}], lambda x: x IS NOT NULL) AS issues, {len(columns) + 1} AS width
FROM (SELECT COUNT(*) AS rows, {counts}{rules} FROM {source}) a,
 (SELECT COUNT(*) AS dups FROM (SELECT 1 FROM {source} GROUP BY LOWER(TRIM({named})) HAVING COUNT(*) > 1) g) b"""


SCORED = (
    """SELECT "table", record_count, null_fields, duplicate_records, array_to_string(issues, ' | ') AS issues,
 ROUND(GREATEST(100 - LEAST(CAST(null_fields AS DOUBLE) / (record_count * width) * 100 * 2, 50) - LEAST(len(issues) * 10.0::DOUBLE, 30), 0) * 10) / 10 AS data_quality_score
FROM ("""
    + " UNION ALL ".join(_report_sql(name) for name in COLUMNS)
    + ") x"
)
# The bands of a score.
BAND = "CASE WHEN {0} >= 90 THEN 'excellent' WHEN {0} >= 70 THEN 'good' ELSE 'low' END"


@query("q13_quality_score", f"SELECT \"table\", data_quality_score FROM ({SCORED}) s")
def _(t):
    return quality.quality_report(_dirty(t))[0].select("table", "data_quality_score")


@query(
    "q14_quality_band",
    f"SELECT \"table\", {BAND.format('data_quality_score')} AS band FROM ({SCORED}) s",
)
def _(t):
    return quality.quality_report(_dirty(t))[0].select("table", "band")


@query("q15_quality_report", SCORED)
def _(t):
    per_table = quality.quality_report(_dirty(t))[0]
    return per_table.withColumn("issues", F.array_join("issues", " | ")).drop("band")


@query(
    "q15_quality_summary",
    f"""SELECT *, {BAND.format('average_quality_score')} AS band FROM (SELECT COUNT(*) AS total_tables, CAST(SUM(record_count) AS BIGINT) AS total_records,
 CAST(SUM(null_fields) AS BIGINT) AS total_nulls, CAST(SUM(duplicate_records) AS BIGINT) AS total_duplicates,
 ROUND(CAST(SUM(CAST(data_quality_score AS DECIMAL(5,1))) AS DOUBLE) / COUNT(*) * 10) / 10 AS average_quality_score FROM ({SCORED}) s) y""",
)
def _(t):
    return quality.quality_report(_dirty(t))[1]


VALIDATED = {
    "categories": {
        "missing_id": "id IS NULL",
        "missing_categorias": "categorias IS NULL OR categorias = ''",
        "missing_links": "links IS NULL OR links = ''",
        "bad_url": "links NOT LIKE 'http%' AND links != ''",
        "short_name": "LENGTH(TRIM(categorias)) < 2",
        "future_created_at": f"created_at > {AS_OF_TS}",
    },
    "restaurants": {
        "missing_id": "id IS NULL",
        "missing_name": "name IS NULL OR name = ''",
        "missing_category": "category IS NULL OR category = ''",
        "missing_city": "city IS NULL OR city = ''",
        "rating_out_of_range": "rating < 0 OR rating > 5",
    },
    "products": {"missing_id": "id IS NULL", "missing_name": "name IS NULL OR name = ''"},
}
VALIDATE_SQL = " UNION ALL ".join(
    [
        f"SELECT '{table}' AS \"table\", '{rule}' AS rule, COUNT(*) AS n, true AS counted FROM {{{table}_dirty}} WHERE {sql}"
        for table, rules in VALIDATED.items()
        for rule, sql in rules.items()
    ]
    + [
        f"""SELECT '{table}' AS "table", 'repeated_name' AS rule, COUNT(*) AS n, false AS counted
FROM (SELECT 1 FROM {{{table}_dirty}} GROUP BY {column} HAVING COUNT(*) > 1) g"""
        for table, column in NAMED.items()
    ]
)


@query("q16_validate", VALIDATE_SQL)
def _(t):
    return quality.validate(_dirty(t), quality.default_rules(AS_OF))


@query(
    "q16_validate_dishes",
    """SELECT 'dishes' AS "table", 'missing_id' AS rule, COUNT(*) AS n, true AS counted FROM {products_dirty} WHERE id IS NULL
UNION ALL SELECT 'dishes', 'missing_name', COUNT(*), true FROM {products_dirty} WHERE name IS NULL OR name = ''""",
)
def _(t):
    dishes = conform(t.products_dirty, DISHES)
    return quality.validate({"dishes": dishes}, quality.default_rules(AS_OF))


@query(
    "q16_validation_totals",
    f'SELECT "table", CAST(SUM(n) AS BIGINT) AS issues FROM ({VALIDATE_SQL}) v WHERE counted GROUP BY ROLLUP ("table")',
)
def _(t):
    return quality.validation_totals(quality.validate(_dirty(t), quality.default_rules(AS_OF)))


@query(
    "q17_is_valid",
    r"""SELECT pos, COALESCE(regexp_matches(restaurant_id, '^[+-]?\d+$'), false) AS integer_ok,
 COALESCE(regexp_matches(price, '^[+-]?(\d+(\.\d*)?|\.\d+)$'), false) AS decimal_ok,
 COALESCE(lower(available) IN ('true', 'false', '1', '0', 'sim', 'não', 's', 'n'), false) AS boolean_ok,
 COALESCE(length(valid_until) = 10 AND length(valid_until) - length(replace(valid_until, '-', '')) = 2, false) AS date_ok,
 name IS NOT NULL AS text_ok FROM {typed_in}""",
)
def _(t):
    return t.typed_in.select(
        "pos",
        is_valid(F.col("restaurant_id"), "INTEGER").alias("integer_ok"),
        is_valid(F.col("price"), "DECIMAL(10,2)").alias("decimal_ok"),
        is_valid(F.col("available"), "BOOLEAN").alias("boolean_ok"),
        is_valid(F.col("valid_until"), "DATE").alias("date_ok"),
        is_valid(F.col("name"), "VARCHAR(255)").alias("text_ok"),
    )


# --- enrichment -------------------------------------------------------------

MEANS = """(SELECT category AS k, AVG(rating) AS m_rating, AVG(delivery_time) AS m_delivery_time,
 AVG(delivery_fee) AS m_delivery_fee, AVG(min_order) AS m_min_order FROM {restaurants} WHERE category IS NOT NULL GROUP BY category)"""
FILLED = {
    "rating": """COALESCE(rating, CAST(ROUND(m_rating, 1) AS DECIMAL(2,1)),
 CAST((SELECT ROUND(AVG(rating), 1) FROM {restaurants}) AS DECIMAL(2,1)), CAST(4.0 AS DECIMAL(2,1)))""",
    "delivery_time": "COALESCE(delivery_time, CAST(trunc(m_delivery_time) AS INT), 45)",
    "delivery_fee": "COALESCE(delivery_fee, CAST(ROUND(m_delivery_fee, 2) AS DECIMAL(10,2)), CAST(5.00 AS DECIMAL(10,2)))",
    "min_order": "COALESCE(min_order, CAST(ROUND(m_min_order, 2) AS DECIMAL(10,2)), CAST(25.00 AS DECIMAL(10,2)))",
}
REVIEWS = """COALESCE(reviews, CASE WHEN rating IS NULL THEN 25 WHEN rating >= 4.5 THEN CAST((rating - 3.0) * 200 + 50 AS INT)
 WHEN rating >= 4.0 THEN CAST((rating - 3.0) * 150 + 30 AS INT) WHEN rating >= 3.5 THEN CAST((rating - 3.0) * 100 + 20 AS INT)
 ELSE CAST((rating - 2.0) * 50 + 10 AS INT) END)"""


def _filled(*columns: str) -> str:
    replaced = ", ".join(f"{FILLED[c]} AS {c}" for c in columns)
    return f"SELECT r.* REPLACE ({replaced}) FROM {{restaurants}} r LEFT JOIN {MEANS} m ON r.category = m.k"


@query(
    "e1_missing_analysis",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT(*) AS total, COUNT(*) - COUNT({c}) AS missing,
 CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*) * 100 AS pct FROM {{restaurants}}"""
        for c in enrich.ENRICHED
    ),
)
def _(t):
    return enrich.missing_analysis(t.restaurants)


@query(
    "e7_affected",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(*) AS affected FROM {{restaurants}} WHERE {c} IS NULL" for c in enrich.ENRICHED),
)
def _(t):
    return enrich.filled_counts(t.restaurants)


@query("e2_fill_rating", _filled("rating"))
def _(t):
    return enrich.fill_rating(t.restaurants)


@query("e3_fill_delivery_time", _filled("delivery_time"))
def _(t):
    return enrich.fill_delivery_time(t.restaurants)


@query("e4_fill_delivery_fee", _filled("delivery_fee"))
def _(t):
    return enrich.fill_delivery_fee(t.restaurants)


@query("e5_fill_reviews", f"SELECT * REPLACE ({REVIEWS} AS reviews) FROM {{restaurants}}")
def _(t):
    return enrich.fill_reviews(t.restaurants)


@query("e6_fill_min_order", _filled("min_order"))
def _(t):
    return enrich.fill_min_order(t.restaurants)


@query("e7_fill_all", f"SELECT * REPLACE ({REVIEWS} AS reviews) FROM ({_filled(*FILLED)}) f")
def _(t):
    return enrich.fill_all(t.restaurants)
