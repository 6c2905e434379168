"""Ingest as queries: parsing, category links, new rows, the stream."""

from pyspark.sql import functions as F

from marketlens.functions import parse
from marketlens.operators import ingest
from marketlens.plans.derived import AS_OF, BASE_URL
from marketlens.plans.registry import query
from marketlens.sources.scratch import new_path
from marketlens.streaming.ingest import stream_ingest, table_so_far
from marketlens.streaming.state import KeyState

# The patterns and texts of this module are those the scraped pages are read by.
NUMBER = r"'^[+-]?(\d+(\.\d*)?|\.\d+)$'"


def _number(text: str, kind: str) -> str:
    return f"CASE WHEN regexp_matches({text}, {NUMBER}) THEN TRY_CAST({text} AS {kind}) END"


def _amount(text: str) -> str:
    return _number(f"trim(replace(replace({text}, 'R$', ''), ',', '.'))", "DECIMAL(10,2)")


def _group(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', {group}), '')"


MIDDLE = "CAST(floor((CAST({0} AS INT) + CAST({1} AS INT)) / 2) AS INT)".format(
    _group("time_txt", r"(\d+)-(\d+)\s*min", 1), _group("time_txt", r"(\d+)-(\d+)\s*min", 2)
)
RATING_TEXT = "trim(replace(nullif({0}, 'N/A'), '★', ''))"
INFO_RATING = "CASE WHEN info_txt != 'N/A' THEN trim(split_part(info_txt, '•', 1)) END"
MINUTES = f"COALESCE({MIDDLE}, CAST({_group('time_txt', chr(92) + 'd+', 0)} AS INT))"
FEE = f"CASE WHEN fee_txt = '0' OR lower(fee_txt) = 'grátis' THEN CAST(0 AS DECIMAL(10,2)) ELSE {_amount('fee_txt')} END"
MIN_ORDER = _number("replace(" + _group("min_txt", r"R\$\s*(\d+[.,]?\d*)") + ", ',', '.')", "DECIMAL(10,2)")
REVIEWS = f"CAST({_group('translate(reviews_txt, %s, %s)' % (repr('.,'), repr('')), chr(92) + 'd+', 0)} AS INT)"
LINK = f"""CASE WHEN href LIKE '/%' THEN concat('{BASE_URL}', href) WHEN href IS NOT NULL AND href != 'N/A' THEN href
 ELSE concat('{BASE_URL}/delivery/', replace(lower(cidade), ' ', '-'), '-sp/', replace(lower(nome), ' ', '-')) END"""


@query(
    "g1_split_info",
    """SELECT pos, CASE WHEN info_txt = 'N/A' THEN 'N/A' ELSE trim(split_part(info_txt, '•', 1)) END AS rating,
 COALESCE(nullif(trim(split_part(info_txt, '•', 2)), ''), 'N/A') AS kind,
 COALESCE(nullif(trim(split_part(info_txt, '•', 3)), ''), 'N/A') AS distance FROM {staging}""",
)
def _(t):
    return t.staging.select("pos", parse.split_info(F.col("info_txt")).alias("info")).select("pos", "info.*")


@query("g2_parse_rating", f"SELECT pos, {_number(RATING_TEXT.format('rating_txt'), 'DECIMAL(2,1)')} AS rating FROM {{staging}}")
def _(t):
    return t.staging.select("pos", parse.parse_rating(F.col("rating_txt")).alias("rating"))


@query(
    "g2_parse_rating_detail",
    f"""SELECT pos, CASE WHEN regexp_matches(x, {NUMBER}) THEN CAST(x AS DECIMAL(2,1)) END AS rating FROM
(SELECT pos, COALESCE({_group("rating_txt", chr(92) + "d+" + chr(92) + ".?" + chr(92) + "d*", 0)}, {INFO_RATING}) AS x FROM {{staging}}) y""",
)
def _(t):
    info = parse.split_info(F.col("info_txt"))["rating"]
    return t.staging.select("pos", parse.parse_rating(info, F.col("rating_txt")).alias("rating"))


@query("g3_parse_minutes", f"SELECT pos, {MINUTES} AS delivery_time FROM {{staging}}")
def _(t):
    return t.staging.select("pos", parse.parse_minutes(F.col("time_txt"), F.col("fee_txt")).alias("delivery_time"))


@query("g4_parse_fee", f"SELECT pos, {FEE} AS delivery_fee FROM {{staging}}")
def _(t):
    return t.staging.select("pos", parse.parse_fee(F.col("fee_txt")).alias("delivery_fee"))


@query(
    "g5_parse_price",
    f"SELECT pos, {_amount('preco')} AS price FROM {{product_staging}}",
)
def _(t):
    return t.product_staging.select("pos", parse.parse_price(F.col("preco")).alias("price"))


PRICE_FALLBACK = "COALESCE(nullif(preco, 'N/A'), " + _group("item_txt", r"R\$\s*\d+[.,]\d{2}", 0) + ")"


@query(
    "g5_parse_price_fallback",
    f"SELECT pos, {_amount('shown')} AS price FROM (SELECT pos, {PRICE_FALLBACK} AS shown FROM {{product_staging}}) s",
)
def _(t):
    return t.product_staging.select("pos", parse.parse_price(F.col("preco"), F.col("item_txt")).alias("price"))


@query("g6_parse_min_order", f"SELECT pos, {MIN_ORDER} AS min_order FROM {{staging}}")
def _(t):
    return t.staging.select("pos", parse.parse_min_order(F.col("min_txt")).alias("min_order"))


@query(
    "g6_parse_min_order_fallback",
    "SELECT pos, CAST(replace(COALESCE("
    + ", ".join(
        [
            _group("min_txt", r"R\$\s*(\d+[.,]?\d*)"),
            _group("card_txt", r"(?i)mínimo.*?R\$\s*(\d+[.,]?\d*)"),
            _group("card_txt", r"(?i)pedido.*?R\$\s*(\d+[.,]?\d*)"),
        ]
    )
    + "), ',', '.') AS DECIMAL(10,2)) AS min_order FROM {staging}",
)
def _(t):
    return t.staging.select("pos", parse.parse_min_order(F.col("min_txt"), F.col("card_txt")).alias("min_order"))


@query("g7_parse_reviews", f"SELECT pos, {REVIEWS} AS reviews FROM {{staging}}")
def _(t):
    return t.staging.select("pos", parse.parse_reviews_detail(F.col("reviews_txt")).alias("reviews"))


@query(
    "g7_parse_reviews_fallback",
    "SELECT pos, CAST(COALESCE("
    + ", ".join(
        [
            _group("reviews_txt", r"\d+", 0),
            _group("card_txt", r"\((\d+)\)"),
            _group("card_txt", r"(?i)(\d+)\s*avalia"),
            _group("card_txt", r"(?i)(\d+)\s*review"),
        ]
    )
    + ") AS INT) AS reviews FROM {staging}",
)
def _(t):
    return t.staging.select("pos", parse.parse_reviews(F.col("reviews_txt"), F.col("card_txt")).alias("reviews"))


@query("g8_resolve_link", f"SELECT pos, {LINK} AS link FROM {{staging}}")
def _(t):
    link = parse.resolve_link(F.col("href"), F.col("nome"), F.col("cidade"), BASE_URL)
    return t.staging.select("pos", link.alias("link"))


@query(
    "g9_pick_description",
    """SELECT pos, CASE WHEN descricao != 'N/A' THEN descricao WHEN length(item_txt) > 10 AND item_txt NOT LIKE '%R$%' AND item_txt != nome THEN item_txt
 WHEN length(nome) > 10 AND nome != trim(nome) THEN nome WHEN length(restaurant_name) > 6 THEN concat(restaurant_name, ' da casa') END AS description
FROM {product_staging}""",
)
def _(t):
    named = F.when(F.col("nome") != F.trim("nome"), F.col("nome"))
    house = F.when(F.length("restaurant_name") > 6, F.concat("restaurant_name", F.lit(" da casa")))
    candidates = F.array(F.col("item_txt"), named, house)
    # The item's own name is the trimmed one, so the untrimmed text is a candidate.
    description = parse.pick_description(candidates, F.trim("nome"), F.col("descricao"))
    return t.product_staging.select("pos", description.alias("description"))


@query("g10_accept_products", "SELECT * FROM {product_staging} WHERE nome != 'N/A' AND length(nome) > 2")
def _(t):
    return ingest.accept_products(t.product_staging)


ANCHOR_SQL = r"""'(?is)<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a>'"""
LINKS_SQL = rf"""SELECT page_id, CAST(pos - 1 AS INT) AS pos, trim(text) AS nome,
 CASE WHEN href LIKE 'http%' THEN href ELSE concat('{BASE_URL}', href) END AS link
FROM (SELECT page_id, unnest(range(1, len(hrefs) + 1)) AS pos, unnest(hrefs) AS href, unnest(texts) AS raw, regexp_replace(raw, '<[^>]*>', '', 'gs') AS text
 FROM (SELECT page_id, regexp_extract_all(html, {ANCHOR_SQL}, 1) AS hrefs, regexp_extract_all(html, {ANCHOR_SQL}, 2) AS texts FROM pages) a) b
WHERE href LIKE '%/%' AND length(text) > 2"""


@query("g11_extract_links", LINKS_SQL)
def _(t):
    return ingest.extract_links(t.pages, BASE_URL, marker="/")


def _like_any(terms) -> str:
    return "(" + " OR ".join(f"contains(lower(nome), '{term}')" for term in terms) + ")"


CATEGORIES_SQL = f"""SELECT page_id, pos, nome, link FROM (SELECT *, row_number() OVER (PARTITION BY nome ORDER BY page_id, pos) AS k
 FROM ({LINKS_SQL}) l WHERE NOT {_like_any(ingest.DENY_TERMS)} AND ({_like_any(ingest.ALLOW_TERMS)} OR length(nome) <= 15)) m WHERE k = 1"""


def _category_links(t):
    return ingest.filter_categories(ingest.extract_links(t.pages, BASE_URL, marker="/"))


@query("g12_filter_categories", CATEGORIES_SQL)
def _(t):
    return _category_links(t)


PARSED = f"""SELECT pos, nome AS name, categoria AS category,
 {_number(RATING_TEXT.format(f"COALESCE(nullif(rating_txt, 'N/A'), {INFO_RATING})"), "DECIMAL(2,1)")} AS rating,
 {MINUTES} AS delivery_time, {FEE} AS delivery_fee, cidade AS city, {LINK} AS link, {REVIEWS} AS reviews, {MIN_ORDER} AS min_order,
 CAST('{AS_OF}' AS TIMESTAMP) AS scraped_at FROM {{staging}}"""


def _new_sql(parsed: str, existing: str, keys: list[tuple[str, str]], columns: str, order: str = "pos") -> str:
    """Rows that are the first of their key and not in the table, numbered after it."""
    partition = ", ".join(sql for _, sql in keys)
    complete = " AND ".join(f"{column} IS NOT NULL" for column, _ in keys)
    same = " AND ".join(f"{sql.replace(column, 'e.' + column)} = {sql.replace(column, 's.' + column)}" for column, sql in keys)
    return f"""SELECT row_number() OVER (ORDER BY {order}) + (SELECT MAX(id) FROM {{{existing}}}) AS id, {columns}
FROM (SELECT *, row_number() OVER (PARTITION BY {partition}, CASE WHEN {complete} THEN -1 ELSE pos END ORDER BY {order}) AS k FROM ({parsed}) q) s
WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM {{{existing}}} e WHERE {same})"""


RESTAURANT_COLUMNS = "name, category, rating, delivery_time, delivery_fee, city, link, reviews, min_order, scraped_at"
RESTAURANT_KEYS = [("name", "lower(trim(name))"), ("city", "lower(trim(city))")]
NEW_RESTAURANTS = _new_sql(PARSED, "known_restaurants", RESTAURANT_KEYS, RESTAURANT_COLUMNS)


def _parsed(t):
    return ingest.parse_cards(t.staging, BASE_URL, AS_OF)


@query("g13_parse_cards", PARSED)
def _(t):
    return _parsed(t)


@query("g13_insert_new_restaurants", NEW_RESTAURANTS)
def _(t):
    return ingest.insert_new_restaurants(t.known_restaurants, _parsed(t))


PRODUCT_COLUMNS = "restaurant_id, restaurant_name, category, name, description, price, scraped_at"
PRODUCT_KEYS = [("name", "lower(trim(name))"), ("restaurant_id", "restaurant_id"), ("category", "lower(trim(category))")]
PARSED_PRODUCTS = f"""SELECT pos, restaurant_id, restaurant_name, category, nome AS name, nullif(descricao, 'N/A') AS description,
 {_amount('preco')} AS price, CAST('{AS_OF}' AS TIMESTAMP) AS scraped_at FROM {{product_staging}} WHERE nome != 'N/A' AND length(nome) > 2"""
NEW_PRODUCTS = _new_sql(PARSED_PRODUCTS, "known_products", PRODUCT_KEYS, PRODUCT_COLUMNS)


@query("g14_insert_new_products", NEW_PRODUCTS)
def _(t):
    return ingest.insert_new_products(t.known_products, ingest.parse_products(t.product_staging, AS_OF))


CATEGORY_BATCH = f"""SELECT page_id, pos, nome AS categorias, link AS links, CAST('{AS_OF}' AS TIMESTAMP) AS created_at FROM ({CATEGORIES_SQL}) c"""
CATEGORY_KEYS = [("categorias", "lower(trim(categorias))")]
CATEGORY_COLUMNS = "categorias, links, created_at"


@query("g15_insert_new_categories", _new_sql(CATEGORY_BATCH, "categories_dirty", CATEGORY_KEYS, CATEGORY_COLUMNS, "page_id, pos"))
def _(t):
    return ingest.insert_new_categories(t.categories_dirty, _category_links(t), AS_OF, ("page_id", "pos"))


@query(
    "g16_assign_ids",
    "SELECT *, row_number() OVER (ORDER BY pos) + (SELECT MAX(id) FROM {restaurants}) AS id FROM {product_staging}",
)
def _(t):
    return ingest.assign_ids(t.product_staging, t.restaurants)


@query(
    "g17_run_counters",
    f"""SELECT saved, total - saved - errors AS duplicates, errors, CAST(saved AS DOUBLE) / total * 100 AS efficiency FROM
(SELECT (SELECT COUNT(*) FROM ({NEW_RESTAURANTS}) n) AS saved, COUNT(*) AS total, COUNT(*) FILTER (nome IS NULL) AS errors FROM {{staging}}) x""",
)
def _(t):
    return ingest.count_run(t.known_restaurants, _parsed(t), ingest.RESTAURANT_KEY, ingest.RESTAURANT_REQUIRED)


@query(
    "g18_refresh",
    f"""SELECT row_number() OVER (ORDER BY page_id, pos) AS id, {CATEGORY_COLUMNS} FROM
(SELECT *, row_number() OVER (PARTITION BY lower(trim(categorias)) ORDER BY page_id, pos) AS k FROM ({CATEGORY_BATCH}) b) s WHERE k = 1""",
)
def _(t):
    return ingest.refresh(t.categories_dirty, _category_links(t), AS_OF, ("page_id", "pos"))


@query("g19_stream_ingest", f"SELECT * FROM {{known_restaurants}} UNION ALL {NEW_RESTAURANTS}")
def _(t):
    base = new_path(t.spark, "stream")
    cards = t.staging
    cards.write.parquet(f"{base}/in")

    def parse(batch):
        return ingest.parse_cards(batch, BASE_URL, AS_OF)

    stream_ingest(
        t.spark,
        f"{base}/in",
        f"{base}/out",
        f"{base}/checkpoint",
        cards.schema,
        t.known_restaurants,
        lambda known, batch: ingest.insert_new_restaurants(known, parse(batch)),
        state=KeyState(f"{base}/out", ingest.RESTAURANT_KEY, t.known_restaurants.schema, buckets=16),
        parse=parse,
    ).awaitTermination()
    return table_so_far(t.spark, f"{base}/out", t.known_restaurants.schema)
