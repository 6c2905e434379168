"""Marketplace tables derived from the given ones.

Each is one SELECT that Spark and DuckDB read alike; names in braces are other
tables. Every derived table covers its source tables whole.
"""

AS_OF = "2024-01-31 00:00:00"
BASE_URL = "https://example.com"

RAW = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

DERIVED = {
    "restaurants": """
SELECT c.c_custkey AS id, c.c_name AS name, c.c_mktsegment AS category,
 CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE CAST((25 + c.c_custkey % 26) / 10.0 AS DECIMAL(2,1)) END AS rating,
 CASE WHEN c.c_mktsegment = 'HOUSEHOLD' OR c.c_custkey % 4 = 0 THEN NULL ELSE CAST(15 + c.c_custkey % 46 AS INT) END AS delivery_time,
 CASE WHEN c.c_custkey % 5 = 0 THEN NULL WHEN c.c_custkey % 5 = 1 THEN CAST(0 AS DECIMAL(10,2)) ELSE CAST((c.c_custkey % 1500) / 100.0 AS DECIMAL(10,2)) END AS delivery_fee,
 n.n_name AS city,
 CASE WHEN c.c_custkey % 11 = 0 THEN 'N/A' WHEN c.c_custkey % 13 = 0 THEN NULL ELSE concat('https://example.com/', CAST(c.c_custkey AS STRING)) END AS link,
 CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE CAST(c.c_custkey % 500 AS INT) END AS reviews,
 CASE WHEN c.c_custkey % 6 = 0 THEN NULL ELSE CAST(10 + c.c_custkey % 40 AS DECIMAL(10,2)) END AS min_order,
 CAST(concat('2024-01-', lpad(CAST(1 + c.c_custkey % 28 AS STRING), 2, '0'), ' 00:00:00') AS TIMESTAMP) AS scraped_at
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    # Every order takes the part whose number is the rest of its own by the number of parts, so all parts are used.
    # Orders of every eighth customer count for the one before it, who thus owns
    # twice as many, and leave that customer without products.
    "products": """
SELECT o.o_orderkey AS id, c.c_custkey AS restaurant_id, c.c_name AS restaurant_name,
 p.p_type AS category, concat(p.p_name, ' ', CAST(o.o_orderkey AS STRING)) AS name,
 CASE WHEN o.o_orderkey % 5 = 0 THEN NULL WHEN o.o_orderkey % 5 = 1 THEN '' ELSE p.p_brand END AS description,
 CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE CAST(o.o_totalprice AS DECIMAL(10,2)) END AS price,
 o.o_orderdate AS scraped_at
FROM (SELECT *, o_orderkey % (SELECT MAX(p_partkey) + 1 FROM {part}) AS o_partkey FROM {orders}) o
 JOIN {customer} c ON c.c_custkey = CASE WHEN o.o_custkey % 8 = 7 THEN o.o_custkey - 1 ELSE o.o_custkey END
 JOIN {part} p ON p.p_partkey = o.o_partkey""",
    "categories": """
SELECT CAST(row_number() OVER (ORDER BY c_mktsegment) AS INT) AS id, c_mktsegment AS categorias,
 concat('https://example.com/', lower(c_mktsegment)) AS links,
 CAST('2024-01-15 00:00:00' AS TIMESTAMP) AS created_at
FROM (SELECT DISTINCT c_mktsegment FROM {customer}) t""",
    # Bad values, near-duplicate names, and exact copies of every 25th row.
    "restaurants_dirty": """
WITH spoilt AS (SELECT id,
 CASE WHEN id % 50 = 3 THEN '' WHEN id % 20 = 0 THEN concat('  STORE ', CAST(id % 100 AS STRING)) WHEN id % 20 = 1 THEN concat('Store ', CAST((id - 1) % 100 AS STRING), ' ') ELSE name END AS name,
 category,
 CASE WHEN id % 97 = 5 THEN CAST(7.5 AS DECIMAL(2,1)) WHEN id % 101 = 5 THEN CAST(-1.0 AS DECIMAL(2,1)) ELSE rating END AS rating,
 delivery_time, CASE WHEN id % 89 = 7 THEN CAST(-1 AS DECIMAL(10,2)) ELSE delivery_fee END AS delivery_fee,
 city, link, reviews, min_order,
 CASE WHEN id % 83 = 0 THEN CAST('2099-01-01 00:00:00' AS TIMESTAMP) ELSE scraped_at END AS scraped_at
 FROM {restaurants})
SELECT id, name, category, rating, delivery_time, delivery_fee, city, link, reviews, min_order, scraped_at FROM spoilt
UNION ALL
SELECT id + 1000000000000, name, category, rating, delivery_time, delivery_fee, city, link, reviews, min_order, scraped_at FROM spoilt WHERE id % 25 = 2""",
    "products_dirty": """
SELECT id, CASE WHEN id % 37 = 0 THEN restaurant_id + 1000000000000 WHEN id % 41 = 0 THEN NULL ELSE restaurant_id END AS restaurant_id,
 restaurant_name, category, name, description,
 CASE WHEN id % 61 = 0 THEN CAST(-1 AS DECIMAL(10,2)) ELSE price END AS price, scraped_at
FROM {products}""",
    # Listings as categories: large enough to grow with the data, with bad rows.
    "categories_dirty": """
SELECT c_custkey AS id,
 CASE WHEN c_custkey % 29 = 3 THEN 'X' WHEN c_custkey % 31 = 3 THEN ' a ' WHEN c_custkey % 37 = 3 THEN '' WHEN c_custkey % 41 = 3 THEN concat(' ', upper(c_mktsegment), ' ') ELSE concat(c_mktsegment, ' ', CAST(c_custkey % 500 AS STRING)) END AS categorias,
 CASE WHEN c_custkey % 43 = 3 THEN 'ftp://bad' WHEN c_custkey % 47 = 3 THEN '' ELSE concat('https://example.com/', lower(c_mktsegment)) END AS links,
 CASE WHEN c_custkey % 53 = 3 THEN CAST('2099-01-01 00:00:00' AS TIMESTAMP) ELSE CAST('2024-01-15 00:00:00' AS TIMESTAMP) END AS created_at
FROM {customer}""",
    # Scraped cards, one per order, in order of arrival; several per store.
    "staging": """
SELECT o_orderkey AS pos,
 CASE WHEN o_orderkey % 3 = 0 THEN concat('  LOJA ', CAST(o_custkey AS STRING), ' ') ELSE concat('Loja ', CAST(o_custkey AS STRING)) END AS nome,
 o_orderpriority AS categoria,
 CASE WHEN o_orderkey % 2 = 0 THEN 'Birigui' ELSE 'birigui ' END AS cidade,
 CASE WHEN o_orderkey % 9 = 0 THEN 'N/A' WHEN o_orderkey % 9 = 1 THEN 'Novidade' ELSE concat(CAST(o_orderkey % 6 AS STRING), '.', CAST(o_orderkey % 10 AS STRING), ' ★') END AS rating_txt,
 CASE WHEN o_orderkey % 7 = 6 THEN 'N/A' WHEN o_orderkey % 7 = 5 THEN concat(CAST(o_orderkey % 5 AS STRING), '.0 • Lanches') ELSE concat(CAST(o_orderkey % 6 AS STRING), '.', CAST(o_orderkey % 10 AS STRING), ' • Pizza • ', CAST(o_orderkey % 20 AS STRING), ' km') END AS info_txt,
 CASE WHEN o_orderkey % 4 = 0 THEN concat(CAST(20 + o_orderkey % 15 AS STRING), '-', CAST(40 + o_orderkey % 16 AS STRING), ' min') WHEN o_orderkey % 4 = 1 THEN concat(CAST(30 + o_orderkey % 15 AS STRING), ' min') ELSE 'Agendado' END AS time_txt,
 CASE WHEN o_orderkey % 5 = 0 THEN 'Grátis' WHEN o_orderkey % 5 = 1 THEN 'N/A' WHEN o_orderkey % 5 = 2 THEN 'R$ 1.234,50' ELSE concat('R$ ', CAST(o_orderkey % 30 AS STRING), ',', CAST(10 + o_orderkey % 90 AS STRING)) END AS fee_txt,
 CASE WHEN o_orderkey % 3 = 0 THEN concat('Pedido mínimo R$ ', CAST(10 + o_orderkey % 40 AS STRING), ',00') ELSE 'sem minimo' END AS min_txt,
 CASE WHEN o_orderkey % 3 = 1 THEN concat('1.', CAST(100 + o_orderkey % 900 AS STRING), ' avaliações') ELSE 'sem avaliações' END AS reviews_txt,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'N/A' WHEN o_orderkey % 4 = 2 THEN concat('/loja/', CAST(o_orderkey AS STRING)) ELSE concat('https://example.org/', CAST(o_orderkey AS STRING)) END AS href,
 concat('Loja nova ', CASE WHEN o_orderkey % 4 = 0 THEN concat('(', CAST(o_orderkey % 700 AS STRING), ')') WHEN o_orderkey % 4 = 1 THEN concat(CAST(o_orderkey % 700 AS STRING), ' Avaliações') WHEN o_orderkey % 4 = 2 THEN concat(CAST(o_orderkey % 700 AS STRING), ' reviews') ELSE 'sem nota' END, CASE WHEN o_orderkey % 2 = 0 THEN ' PEDIDO mínimo de R$ 15,50' ELSE ' Pedido a partir de R$30' END) AS card_txt
FROM {orders}""",
    # Restaurants of which every tenth is one of the scraped stores already.
    "known_restaurants": """
SELECT id, CASE WHEN id % 10 = 0 THEN concat('loja ', CAST(id AS STRING)) ELSE name END AS name, category, rating, delivery_time, delivery_fee,
 CASE WHEN id % 10 = 0 THEN 'BIRIGUI' ELSE city END AS city, link, reviews, min_order, scraped_at
FROM {restaurants}""",
    # Scraped menu items, one per order; some name no restaurant or category.
    "product_staging": """
SELECT o_orderkey AS pos,
 CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_custkey END AS restaurant_id,
 concat('Loja ', CAST(o_custkey AS STRING)) AS restaurant_name,
 CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE o_orderstatus END AS category,
 CASE WHEN o_orderkey % 61 = 0 THEN 'N/A' WHEN o_orderkey % 67 = 0 THEN 'ab' WHEN o_orderkey % 2 = 0 THEN concat('ITEM ', CAST(o_orderkey % 7 AS STRING)) ELSE concat(' Item ', CAST(o_orderkey % 7 AS STRING)) END AS nome,
 CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' ELSE concat('Feito na hora ', o_orderpriority) END AS descricao,
 CASE WHEN o_orderkey % 5 = 0 THEN 'N/A' WHEN o_orderkey % 71 = 0 THEN 'sob consulta' WHEN o_orderkey % 11 = 0 THEN 'R$ 1.999,90' ELSE concat('R$ ', replace(CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS STRING), '.', ',')) END AS preco,
 concat('Item do dia R$ ', CAST(o_orderkey % 90 AS STRING), ',50 cada') AS item_txt
FROM {orders}""",
    "known_products": """
SELECT id, restaurant_id, restaurant_name, CASE WHEN id % 3 = 0 THEN 'o' WHEN id % 3 = 1 THEN 'f ' ELSE 'P' END AS category,
 concat('Item ', CAST(id % 7 AS STRING)) AS name, description, price, scraped_at
FROM {products}""",
    "history": """
SELECT event_id AS id, ts, concat('SELECT ', event_type, ' FROM user_', CAST(user_id AS STRING)) AS query,
 value / 100.0 AS execution_time, CAST(user_id AS INT) AS result_count,
 CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
 CASE WHEN event_type = 'error' THEN concat('failed: ', props) ELSE NULL END AS error
FROM {events}""",
    # Review counts and minimum orders that arrived later, some of them unknown.
    "extra_info": """
SELECT s.id, CASE WHEN s.id % 3 = 1 THEN NULL ELSE CAST(s.n AS INT) END AS reviews,
 CASE WHEN s.id % 4 = 1 THEN NULL ELSE CAST(s.n AS DECIMAL(10,2)) END AS min_order
FROM (SELECT o_custkey AS id, count(*) AS n FROM {orders} GROUP BY o_custkey) s""",
    "migrations": """
SELECT concat(CAST(p_size AS STRING), '.', CAST(p_partkey AS STRING)) AS version, p_name AS description,
 concat(p_brand, ' ', p_type) AS text
FROM {part}""",
    "ledger": """
SELECT o.o_orderkey AS id, m.version, m.description, o.o_orderdate AS applied_at, md5(m.text) AS checksum
FROM {orders} o JOIN (SELECT p_partkey, concat(CAST(p_size AS STRING), '.', CAST(p_partkey AS STRING)) AS version, p_name AS description, concat(p_brand, ' ', p_type) AS text FROM {part}) m
 ON m.p_partkey = o.o_custkey""",
    # Rows entered as text, some of them not fit for their column.
    "typed_in": """
SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE concat('Prato ', CAST(o_orderkey AS STRING)) END AS name,
 CASE WHEN o_orderkey % 23 = 0 THEN 'doze' ELSE CAST(o_custkey AS STRING) END AS restaurant_id,
 CASE WHEN o_orderkey % 29 = 0 THEN '12,50' WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS STRING) END AS price,
 CASE WHEN o_orderkey % 3 = 0 THEN 'Sim' WHEN o_orderkey % 3 = 1 THEN 'n' WHEN o_orderkey % 37 = 0 THEN 'talvez' ELSE 'true' END AS available,
 CASE WHEN o_orderkey % 43 = 0 THEN '31/12/2024' ELSE substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 10) END AS valid_until
FROM {orders}""",
    # The properties of every event with some of its columns among them: a key of two types, one that not all have,
    # a key of its own for each user, and texts that are cut off or no object.
    "event_props": """
SELECT event_id, CASE WHEN event_id % 50 = 7 THEN substring(props, 1, 4) WHEN event_id % 50 = 8 THEN '[1]'
 ELSE concat(substring(props, 1, 1), '"type": "', event_type, '", "amount": ', CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS STRING) ELSE concat(CAST(user_id AS STRING), '.25') END,
 CASE WHEN event_id % 4 = 0 THEN ', "seen": true' ELSE '' END, ', "u', CAST(user_id AS STRING), '": ', CAST(event_id AS STRING), ', ', substring(props, 2)) END AS props
FROM {events}""",
}
