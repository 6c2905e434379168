"""Operators on small literal tables: rules the test tables do not reach."""

import math
import re
from contextlib import contextmanager
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketlens.operators import changes, enrich, evolution, filters, ingest, joins, lookup, numbering, paging, quality, querylog, reports
from marketlens.plans.registry import Tables
from marketlens.schemas import RESTAURANTS, TEMPLATES, base_schemas, conform, table_def, template
from marketlens.sources.tables import run_sql

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SMALL)


def rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


# --- skew and size ----------------------------------------------------------


@contextmanager
def no_broadcast(spark):
    """No side is small enough to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows under one key, many with no key at all."""
    key = F.expr("CASE WHEN id % 3 = 0 THEN 7L WHEN id % 11 = 0 THEN NULL ELSE id % 500 END")
    return spark.range(20_000).withColumn("key", key)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_lookup_join_is_the_same_shuffled_and_broadcast(spark, skewed, how, null_safe):
    keys = spark.range(0, 400, 7).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    keys = keys.union(spark.sql("SELECT NULL, -1L"))
    small = lookup.lookup_join(skewed, keys, "key", "k", how, null_safe)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("FileScan") == 1
    expected = rows(small)
    with no_broadcast(spark):
        large = lookup.lookup_join(skewed, keys, "key", "k", how, null_safe)
        plan = large._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("FileScan") == 1
        assert rows(large) == expected
    same = F.col("key").eqNullSafe(F.col("k")) if null_safe else F.col("key") == F.col("k")
    assert rows(large) == rows(skewed.join(keys, same, how).drop("k"))


def test_frequent_keys_of_a_large_lookup_are_split(spark, skewed):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    }
    keys = spark.range(0, 400, 7).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    with no_broadcast(spark):
        for name, value in settings.items():
            spark.conf.set(name, value)
        try:
            joined = lookup.lookup_join(skewed.repartition(13), keys, "key", "k")
            assert len(joined.collect()) == 20_000
            assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        finally:
            for name in settings:
                spark.conf.unset(name)


def test_large_lookups_give_the_same_results(spark, tables):
    def results():
        args = (tables.products_dirty, "restaurant_id", tables.restaurants)
        return [
            rows(frame)
            for frame in (
                enrich.fill_all(tables.restaurants),
                joins.orphans(*args),
                changes.drop_orphans(*args),
                joins.top_items(tables.restaurants, tables.products),
                filters.restaurants_by_category(tables.restaurants, block=7),
            )
        ]

    expected = results()
    with no_broadcast(spark):
        assert results() == expected


def test_positions_are_dense_whatever_the_keys(spark, skewed):
    order = [F.asc_nulls_last("key"), F.desc("id")]
    placed = numbering.with_position(skewed.repartition(13), order, "at")
    got = [(r["at"], r["key"], r["id"]) for r in placed.orderBy("at").collect()]
    assert [g[0] for g in got] == list(range(20_000))
    assert got == sorted(got, key=lambda g: (math.inf if g[1] is None else g[1], -g[2]))


def test_first_per_key_limits_groups_before_the_shuffle(skewed):
    frame = ingest.first_per_key(skewed, [F.col("key")], ["id"])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert frame.count() == skewed.select("key").distinct().count()


def test_long_lists_are_split(spark):
    listing = spark.range(2_500).selectExpr(
        "id", "concat('n', lpad(id, 5, '0')) AS name", "CASE WHEN id < 2400 THEN 'a' END AS category", "'l' AS link"
    )
    lists = filters.restaurants_by_category(listing, block=1000)
    sizes = {(r["category"], r["part"]): len(r["restaurants"]) for r in lists.collect()}
    assert sizes == {("a", 0): 1000, ("a", 1): 1000, ("a", 2): 400, (None, 0): 100}
    first = lists.where("part = 1 AND category = 'a'").first()["restaurants"]
    assert [r["id"] for r in first] == list(range(1000, 2000))


# --- pages ------------------------------------------------------------------


def test_pages_at_any_offset(spark, tables):
    ordered = sorted(
        (tuple(r) for r in tables.products.select("price", "id").collect()), key=lambda r: (r[0] is None, r[0], r[1])
    )
    for number in (1, 4, 14):
        page = paging.page_ordered(tables.products, number, 100, "price", "asc").select("price", "id")
        assert [tuple(r) for r in page.collect()] == ordered[(number - 1) * 100 : number * 100]
    numbers = spark.range(100_150)
    for number in (1, 10_000, 10_001):
        found = [r.id for r in paging.page(numbers, number, 10).collect()]
        assert found == list(range((number - 1) * 10, number * 10))


def test_top_items_limit_groups_before_the_shuffle(tables):
    plan = joins.top_items(tables.restaurants, tables.products)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_products_use_every_part(tables):
    assert tables.products.count() == tables.orders.count()
    used = tables.products.select("category", F.regexp_replace("name", " [0-9]+$", "").alias("name")).distinct()
    assert used.count() == tables.part.select("p_type", "p_name").distinct().count()


def test_small_batch_leaves_the_table_in_place(spark):
    existing = spark.createDataFrame([(i, f"n{i}") for i in range(1000)], "id long, categorias string")
    batch = spark.createDataFrame([(1, 1, "n5"), (1, 2, "new"), (0, 2000, "new"), (2, 1, " NEW ")], "page_id int, pos int, categorias string")
    fresh = ingest.new_rows(existing, batch, ingest.CATEGORY_KEY, ("categorias",), ("page_id", "pos"))
    assert [tuple(r) for r in fresh.collect()] == [(0, 2000, "new")]
    # The batch is ranked once and written; no window is left in the plan.
    assert "Window" not in fresh._jdf.queryExecution().optimizedPlan().toString()


def test_page_limits(tables):
    for bad in (lambda: paging.page(tables.products, 0), lambda: paging.page(tables.products, 1, 101)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        paging.page_ordered(tables.products, 1, 4)
    with pytest.raises(ValueError):
        filters.in_range(tables.products, "price")


def test_top_k_is_not_a_full_sort(tables):
    for frame in (paging.latest(tables.products), paging.sample_rows(tables.products), paging.page_after(tables.products, 5)):
        assert "TakeOrderedAndProject" in frame._jdf.queryExecution().executedPlan().toString()


def test_pages_have_one_plan_at_every_offset(spark):
    def shape(number):
        plan = paging.page(spark.range(100_150), number, 10)._jdf.queryExecution().executedPlan().toString()
        return re.findall(r"[+:]- (?:\*\(\d+\) )?(\w+)", plan)

    assert shape(1) == shape(10_000) == shape(10_001) != []


def test_reports_come_in_order(tables):
    """By frame: columns its rows are sorted by, "-" before those in descending order. Later keys are not shown by all."""
    r, p, history = tables.restaurants, tables.products, tables.history
    frames = [
        (reports.top_rated(r), "-rating name"),
        (reports.category_summary(r), "-total category"),
        (reports.priciest(p), "-price"),
        (reports.price_by_category(p), "-avg_price category"),
        (reports.rating_bands(r), "-avg_rating"),
        (reports.collected_counts(tables.staging, "categoria"), "categoria"),
        (joins.menu_size(r, p), "-total_products -rating"),
        (joins.top_item_per_restaurant(r, p), "-price"),
        (joins.with_products(r, p), "name id"),
        (joins.category_analysis(r, p), "-total_products restaurant_category"),
        (joins.price_matrix(r, p), "restaurant_category -avg_price product_category"),
        (joins.missing_descriptions(r, p), "-products_without_description"),
        (querylog.recent_queries(history), "-ts -id"),
        (querylog.recent_errors(history), "ts id"),
        (querylog.slowest(history), "-execution_time id"),
        (querylog.search_log(history, "from"), "ts id"),
    ]
    for frame, keys in frames:
        got = [row.asDict() for row in frame.collect()]
        assert got
        expected = got
        # Stable sorts, least important key first; nulls are last.
        for key in reversed(keys.split()):
            name, falling = key.lstrip("-"), key[0] == "-"
            known = sorted((row for row in expected if row[name] is not None), key=lambda row: row[name], reverse=falling)
            expected = known + [row for row in expected if row[name] is None]
        assert got == expected, keys


def test_views_of_the_session_outlive_a_query(spark):
    spark.range(3).createOrReplaceTempView("mine")
    frames = {"mine": spark.range(5), "other": spark.range(7)}
    counted = run_sql(spark, frames, "SELECT (SELECT COUNT(*) FROM mine) AS a, (SELECT COUNT(*) FROM other) AS b;")
    assert spark.table("mine").count() == 3 and not spark.catalog.tableExists("other")
    assert tuple(counted.first()) == (5, 7)
    with pytest.raises(Exception, match="nowhere"):
        run_sql(spark, frames, "SELECT * FROM nowhere")
    assert spark.table("mine").count() == 3
    spark.catalog.dropTempView("mine")


def test_time_sums_do_not_overflow(spark):
    log = spark.sql("SELECT timestamp_ntz'2024-01-01' AS ts, 'success' AS status, 9e12D AS execution_time FROM range(4)")
    assert querylog.log_stats(log).first()["avg_time"] == 9e12


def test_filters_reach_the_scan(spark, tables):
    orders = tables.orders
    for frame, expected in [
        (filters.greater(orders, "o_totalprice", "1000"), "GreaterThan(o_totalprice,1000.0)"),
        (filters.equals(orders, "o_orderstatus", "F"), "EqualTo(o_orderstatus,F)"),
        (filters.in_dates(orders, "o_orderdate", "1998-01-01", "1998-02-01"), "LessThanOrEqual(o_orderdate,1998-02-01T00:00)"),
        (changes.retain(orders, "1998-01-31", 30, ["o_orderdate"]), "GreaterThanOrEqual(o_orderdate,1998-01-01T00:00)"),
        (changes.delete_where(orders, "o_orderstatus", "F")[0], "Not(EqualTo(o_orderstatus,F))"),
    ]:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert expected in plan.split("PushedFilters")[1]
    assert "ReadSchema: struct<o_custkey:bigint>" in orders.groupBy("o_custkey").count()._jdf.queryExecution().executedPlan().toString()


# --- quality ----------------------------------------------------------------


def test_scores_of_a_known_report(spark):
    """The published report: 631 restaurants score 20, 20 categories 100, four empty tables 100; mean 86.7."""
    known = [("restaurants", 631, 11, 2662, 5), ("categories", 20, 4, 0, 0)]
    known += [(name, 0, 5, 0, 0) for name in ("dishes", "products", "promotions", "scraping_logs")]
    frame = spark.createDataFrame(known, "table string, record_count long, width int, null_fields long, issues int")
    scored = frame.withColumn(
        "data_quality_score",
        quality.quality_score(F.col("record_count"), F.col("width"), F.col("null_fields"), F.col("issues")),
    ).withColumn("duplicate_records", F.lit(0).cast("bigint"))
    assert {r["table"]: r["data_quality_score"] for r in scored.collect()} == {
        "restaurants": 20.0, "categories": 100.0, "dishes": 100.0, "products": 100.0, "promotions": 100.0, "scraping_logs": 100.0,
    }
    summary = quality.report_summary(scored).first()
    assert (summary["total_tables"], summary["total_records"], summary["total_nulls"]) == (6, 651, 2662)
    assert summary["average_quality_score"] == 86.7 and summary["band"] == "good"


def test_report_of_a_table_like_the_published_one(spark):
    # 631 rows: 333 without rating, 436 without fee, all without time, reviews and minimum.
    frame = spark.range(631).selectExpr(
        "id", "concat('r', id) AS name", "'c' AS category",
        "CAST(IF(id < 333, NULL, 4.0) AS DECIMAL(2,1)) AS rating", "CAST(NULL AS INT) AS delivery_time",
        "CAST(IF(id < 436, NULL, 1.0) AS DECIMAL(10,2)) AS delivery_fee", "'x' AS city", "'http://l' AS link",
        "CAST(NULL AS INT) AS reviews", "CAST(NULL AS DECIMAL(10,2)) AS min_order", "now() AS scraped_at",
    )
    empty = frame.limit(0)
    per_table, _ = quality.quality_report({"restaurants": frame, "dishes": empty})
    found = {r["table"]: r for r in per_table.collect()}
    assert found["restaurants"]["null_fields"] == 2662
    assert found["restaurants"]["data_quality_score"] == 20.0
    assert found["restaurants"]["issues"] == [
        "Campo 'rating': 52.8% valores nulos",
        "Campo 'delivery_time': 100.0% valores nulos",
        "Campo 'delivery_fee': 69.1% valores nulos",
        "Campo 'reviews': 100.0% valores nulos",
        "Campo 'min_order': 100.0% valores nulos",
    ]
    assert found["dishes"]["data_quality_score"] == 100.0 and found["dishes"]["issues"] == []


def test_exact_duplicates_treat_nulls_as_equal(spark):
    frame = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "a", 1), (4, None, None)], "id int, x string, y int")
    assert rows(quality.drop_exact_duplicates(frame)) == [(1, "a", None), (2, "a", 1), (4, None, None)]


def test_orphans_ignore_rows_without_key(spark):
    child = spark.createDataFrame([(1, 10), (2, None), (3, 99)], "id int, r long")
    parent = spark.createDataFrame([(10,)], "id long")
    assert rows(joins.orphans(child, "r", parent)) == [(3, 99)]
    assert rows(changes.drop_orphans(child, "r", parent)) == [(1, 10), (2, None)]
    assert joins.reference_count(child, "r", parent).first()[0] == 1


# --- enrichment -------------------------------------------------------------


def test_fill_without_category_or_mean(spark):
    frame = spark.createDataFrame(
        [
            (1, "a", Decimal("4.0"), 31, Decimal("2.00"), 9, None),
            (2, "a", None, 32, None, None, None),
            (3, None, None, None, None, None, None),
            (4, "b", None, None, None, None, None),
        ],
        "id int, category string, rating decimal(2,1), delivery_time int, delivery_fee decimal(10,2), reviews int, min_order decimal(10,2)",
    )
    assert rows(enrich.fill_all(frame)) == [
        (1, "a", Decimal("4.0"), 31, Decimal("2.00"), 9, Decimal("25.00")),
        (2, "a", Decimal("4.0"), 32, Decimal("2.00"), 180, Decimal("25.00")),
        (3, None, Decimal("4.0"), 45, Decimal("5.00"), 180, Decimal("25.00")),
        (4, "b", Decimal("4.0"), 45, Decimal("5.00"), 180, Decimal("25.00")),
    ]
    unrated = frame.withColumn("rating", F.lit(None).cast("decimal(2,1)"))
    assert {r["rating"] for r in enrich.fill_rating(unrated).collect()} == {Decimal("4.0")}
    assert {r["reviews"] for r in enrich.fill_reviews(unrated).collect()} == {9, 25}


def test_times_are_cut_to_whole_minutes(spark):
    frame = spark.createDataFrame([(1, "a", 10), (2, "a", 11), (3, "a", None)], "id int, category string, delivery_time int")
    assert rows(enrich.fill_delivery_time(frame))[2] == (3, "a", 10)


# --- ingest -----------------------------------------------------------------


def test_new_products_with_incomplete_keys_are_always_new(spark):
    schema = "id long, restaurant_id long, restaurant_name string, category string, name string, description string, price decimal(10,2), scraped_at timestamp"
    existing = spark.createDataFrame([(5, 1, "r", "c", " Pizza ", None, None, None), (6, None, "r", "c", "Bolo", None, None, None)], schema)
    batch = spark.createDataFrame(
        [
            (10, 1, "r", "C ", "pizza", None, None, None),  # there already
            (11, None, "r", "c", "bolo", None, None, None),  # key incomplete
            (12, None, "r", "c", "bolo", None, None, None),  # key incomplete
            (13, 2, "r", "c", "bolo", "first", None, None),
            (14, 2, "r", "c", "BOLO", "second", None, None),  # later copy
            (15, 2, "r", "c", None, None, None, None),  # no name
        ],
        schema.replace("id long", "pos long", 1),
    )
    new = ingest.insert_new_products(existing, batch)
    assert new.schema == existing.schema
    assert [(r["id"], r["name"], r["description"]) for r in new.orderBy("id").collect()] == [
        (7, "bolo", None), (8, "bolo", None), (9, "bolo", "first"),
    ]
    labelled = ingest.label_rows(existing, batch, ingest.PRODUCT_KEY, ingest.PRODUCT_REQUIRED)
    assert {r["pos"]: r["outcome"] for r in labelled.collect()} == {
        10: "duplicate", 11: "saved", 12: "saved", 13: "saved", 14: "duplicate", 15: "error",
    }
    assert tuple(ingest.run_counters(labelled).first()) == (3, 2, 1, 50.0)
    assert tuple(ingest.run_counters(labelled.limit(0)).first()) == (0, 0, 0, 0.0)
    for some, expected in [(batch, (3, 2, 1, 50.0)), (batch.limit(0), (0, 0, 0, 0.0))]:
        counted = ingest.count_run(existing, some, ingest.PRODUCT_KEY, ingest.PRODUCT_REQUIRED)
        assert tuple(counted.first()) == expected


def test_inserting_twice_adds_nothing(tables):
    known = tables.known_restaurants
    batch = ingest.parse_cards(tables.staging, "https://e.com", "2024-01-31")
    once = known.unionByName(ingest.insert_new_restaurants(known, batch))
    assert ingest.insert_new_restaurants(once, batch).count() == 0
    everywhere = ingest.insert_new_restaurants(known, batch, city="Araçatuba")
    assert {r["city"] for r in everywhere.select("city").distinct().collect()} == {"Araçatuba"}


def test_categories_from_anchors(spark):
    html = """<A class='x' HREF="/delivery/pizza"> <b>Pizza</b>
    </A><a href="https://e.org/delivery/2">Restaurante de comida muito boa</a><a href="/delivery/3">Burger da casa</a>
    <a href="/delivery/4">Um nome comprido demais aqui</a><a href="/delivery/5">ok</a><a href="/sobre">Sobre</a>
    <a href="/delivery/6">Pizza</a><abbr href="/delivery/7">Nada</abbr>
    <a class="x" href='/delivery/8?q="a"'>Hamburguer da casa nova</a><a href=/delivery/9 class="y">Comida da casa nova</a>"""
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    links = ingest.extract_links(pages, "https://e.com")
    assert [(r["pos"], r["nome"]) for r in links.orderBy("pos").collect()] == [
        (0, "Pizza"), (1, "Restaurante de comida muito boa"), (2, "Burger da casa"), (3, "Um nome comprido demais aqui"), (6, "Pizza"),
        (7, "Hamburguer da casa nova"), (8, "Comida da casa nova"),
    ]
    found = {r["pos"]: r["link"] for r in links.collect()}
    assert found[7] == 'https://e.com/delivery/8?q="a"' and found[8] == "https://e.com/delivery/9"
    chosen = ingest.filter_categories(links.where("pos < 7")).orderBy("pos").collect()
    assert [(r["nome"], r["link"]) for r in chosen] == [
        ("Pizza", "https://e.com/delivery/pizza"), ("Restaurante de comida muito boa", "https://e.org/delivery/2"),
    ]


# --- changes and evolution --------------------------------------------------


def test_deletes_keep_rows_with_unknown_values(spark):
    frame = spark.createDataFrame([(1, "a"), (2, None)], "id int, x string")
    assert changes.delete_where(frame, "x", None)[0].count() == 2
    frame = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, x string")
    left, affected = changes.delete_where(frame, "x", "a")
    assert rows(left) == [(2, None), (3, "b")] and affected.first()[0] == 1
    changed, affected = changes.update_where(frame, "x", "b", {"x": "c"})
    assert rows(changed) == [(1, "a"), (2, None), (3, "c")] and affected.first()[0] == 1
    with pytest.raises(ValueError):
        changes.update_all(frame, {"id": 1})


def test_insert_rejects_what_does_not_fit(spark):
    schema = table_def([("id", "BIGINT", False, True), ("name", "VARCHAR", False, False), ("n", "INTEGER", True, False), ("d", "DATE", True, False)])
    table = conform(spark.createDataFrame([(4, "a", 1)], "id int, name string, n int"), schema)
    typed = spark.createDataFrame(
        [(1, "b", "7", "2024-02-29"), (2, None, "1", None), (3, "c", "x", None), (4, "d", None, None), (5, "e", "1", "2024-02-30"), (6, "f", "99999999999", None)],
        "pos int, name string, n string, d string",
    )
    added, rejected = changes.insert(table, typed, schema, "pos")
    assert [(r["id"], r["name"], r["n"]) for r in added.orderBy("id").collect()] == [(4, "a", 1), (5, "b", 7), (6, "d", None)]
    assert sorted(r["pos"] for r in rejected.collect()) == [2, 3, 5, 6]


def test_cascade_reaches_tables_found_by_column_name(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, restaurant_id long")
    other = spark.createDataFrame([(1, 1)], "id int, the_restaurant_id long")
    tables = {"restaurants": parent, "products": child, "visits": other, "categories": parent}
    found = {(r["table"], r["column"]): r["count"] for r in changes.dependencies(tables, "restaurants").collect()}
    assert found == {("products", "restaurant_id"): 2, ("visits", "the_restaurant_id"): 1}
    assert changes.dependencies(tables, "categories").count() == 0
    left = changes.delete_cascade(tables, "restaurants", parent.where("id = 1"))
    assert rows(left["restaurants"]) == [(2,)] and rows(left["products"]) == [(2, 2), (3, None)]
    assert left["visits"].count() == 0
    assert changes.delete_cascade(tables, "restaurants")["restaurants"].count() == 0


def test_retention_uses_the_first_age_column_there_is(spark):
    frame = spark.createDataFrame([(1, "2024-01-01"), (2, "2023-11-01"), (3, None)], "id int, d string").selectExpr(
        "id", "CAST(d AS TIMESTAMP) AS created_at"
    )
    assert [r["id"] for r in changes.retain(frame, "2024-01-31").orderBy("id").collect()] == [1, 3]
    assert changes.retain(frame.drop("created_at"), "2024-01-31").count() == 3


def test_migrations_are_recorded_once(spark, tables):
    from marketlens.schemas import SCHEMA_VERSIONS

    ledger = spark.createDataFrame([], SCHEMA_VERSIONS)
    assert evolution.current_version(ledger).first()[0] == "0.0.0"
    market = {"restaurants": tables.restaurants, "products": tables.products, "history": tables.history}
    changed, ledger = evolution.migrate(market, ledger, "2024-01-31")
    assert "updated_at" in changed["restaurants"].columns and "updated_at" not in changed["history"].columns
    assert [(r["id"], r["version"], len(r["checksum"])) for r in ledger.orderBy("id").collect()] == [(1, "1.0.0", 32), (2, "1.2.0", 32)]
    assert evolution.current_version(ledger).first()[0] == "1.2.0"
    _, again = evolution.migrate(changed, ledger, "2024-02-01")
    assert again.count() == 2


def test_table_definitions():
    schema = table_def([("id", "INTEGER", True, True), ("price", "DECIMAL(6,3)", True, False), ("ok", "boolean", False, False)])
    assert [f.nullable for f in schema] == [False, True, False]
    assert schema["price"].dataType.simpleString() == "decimal(6,3)" and schema["id"].metadata == {"key": True}
    with pytest.raises(ValueError):
        table_def([("x", "BLOB", True, False)])
    with pytest.raises(ValueError):
        table_def([("x", "TEXT", True, False), ("X", "TEXT", True, False)])
    assert template("usuarios", "clientes") == ("clientes", TEMPLATES["usuarios"])
    assert set(base_schemas()) == {"categories", "restaurants", "products", "dishes", "promotions", "scraping_logs"}
    assert len(RESTAURANTS) == 11


def test_samples_fit_their_tables(spark):
    for name, (_, examples) in changes.SAMPLES.items():
        schema = base_schemas().get(name) or TEMPLATES[name]
        table = changes.insert_samples(spark.createDataFrame([], schema), name, schema)
        assert [r["id"] for r in table.orderBy("id").collect()] == list(range(1, len(examples) + 1))


def test_a_backslash_is_not_a_wildcard(spark):
    frame = spark.createDataFrame([(r"a\%b",), ("a%b",)], "x string")
    assert rows(filters.contains(frame, "x", "a\\")) == [(r"a\%b",)]
