"""Sources, sinks and snapshots as queries: each writes files and reads them back."""

from pyspark.sql import functions as F

from marketlens.plans.derived import AS_OF
from marketlens.plans.registry import query
from marketlens.sources import files, history, snapshots
from marketlens.sources.scratch import new_path
from marketlens.sources.tables import run_sql

EARLIER = "2024-01-30 00:00:00"


def _market(t):
    return {"restaurants": t.restaurants, "products": t.products, "categories": t.categories}


@query("s1_table", "SELECT * FROM lineitem")
def _(t):
    return t.lineitem


@query("s4_csv", "SELECT * FROM {products}")
def _(t):
    path = new_path(t.spark, "csv")
    files.to_csv(t.products, path)
    return files.import_table(t.spark, path, "csv", t.products.schema, target=new_path(t.spark, "imported"))[0]


@query("s5_json", "SELECT * FROM {restaurants}")
def _(t):
    path = new_path(t.spark, "json")
    files.to_json(t.restaurants, path)
    return t.spark.read.schema(t.restaurants.schema).json(path)


@query("s6_history", "SELECT * FROM {history}")
def _(t):
    path = new_path(t.spark, "history")
    history.append_history(t.history.where("status = 'success'"), path)
    history.append_history(t.history.where("status = 'error'"), path)
    return history.read_history(t.spark, path)


@query("s7_import_json", "SELECT * FROM {staging}")
def _(t):
    path = new_path(t.spark, "import")
    files.to_json(t.staging, path)
    return files.import_table(t.spark, path, "json", t.staging.schema, target=new_path(t.spark, "imported"))[0]


@query("s7_import_rejects", "SELECT COUNT(*) AS rejected FROM {typed_in} WHERE NOT regexp_matches(restaurant_id, '^\\d+$')")
def _(t):
    path = new_path(t.spark, "import")
    files.to_csv(t.typed_in.select("pos", "restaurant_id"), path)
    schema = t.products.selectExpr("id AS pos", "restaurant_id").schema
    _, bad = files.import_table(t.spark, path, "csv", schema, target=new_path(t.spark, "imported"))
    return bad.agg(F.count(F.lit(1)).alias("rejected"))


@query("s8_export", "SELECT * FROM {products}")
def _(t):
    path = new_path(t.spark, "export")
    files.export_table(t.products, path, "orc")
    return t.spark.read.schema(t.products.schema).orc(path)


@query(
    "s9_snapshot",
    """SELECT 'restaurants' AS "table", COUNT(*) AS rows FROM {restaurants}
UNION ALL SELECT 'products', COUNT(*) FROM {products} UNION ALL SELECT 'categories', COUNT(*) FROM {categories}""",
)
def _(t):
    directory = new_path(t.spark, "snapshots")
    entries = snapshots.snapshot(_market(t), directory, AS_OF, cluster_by={"products": "restaurant_id"})
    # Bounded: one name for all entries.
    broken = snapshots.verify(t.spark, directory, entries.first()["snapshot_id"])
    # A table whose files do not match its entry would be missing.
    return entries.join(broken, "table", "left_anti").select("table", "rows")


@query("s10_restore", "SELECT * FROM {products}")
def _(t):
    directory = new_path(t.spark, "snapshots")
    saved = snapshots.snapshot({"products": t.products}, directory, EARLIER)
    # Bounded: the one entry just written.
    snapshot_id = saved.first()["snapshot_id"]
    current = {"products": t.products.limit(0)}
    return snapshots.restore(t.spark, directory, snapshot_id, current, AS_OF)["products"]


@query(
    "s11_list_snapshots",
    f"""SELECT CAST('{AS_OF}' AS TIMESTAMP) AS as_of, 'nightly' AS label, CAST(2 AS BIGINT) AS tables,
 (SELECT COUNT(*) FROM {{restaurants}}) + (SELECT COUNT(*) FROM {{categories}}) AS rows
UNION ALL SELECT CAST('{EARLIER}' AS TIMESTAMP), 'backup', 1, COUNT(*) FROM {{restaurants}}""",
)
def _(t):
    directory = new_path(t.spark, "snapshots")
    snapshots.snapshot({"restaurants": t.restaurants}, directory, EARLIER)
    snapshots.snapshot({"restaurants": t.restaurants, "categories": t.categories}, directory, AS_OF, "nightly")
    return snapshots.list_snapshots(t.spark, directory).select("as_of", "label", "tables", "rows")


@query(
    "s12_diff_tables",
    """SELECT COALESCE(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM {restaurants} a FULL OUTER JOIN {restaurants_dirty} b ON a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR (a.name, a.category, a.rating, a.delivery_time, a.delivery_fee, a.city, a.link, a.reviews, a.min_order, a.scraped_at)
 IS DISTINCT FROM (b.name, b.category, b.rating, b.delivery_time, b.delivery_fee, b.city, b.link, b.reviews, b.min_order, b.scraped_at)""",
)
def _(t):
    return snapshots.diff_tables(t.restaurants, t.restaurants_dirty)


RUN_SQL = """SELECT c.categorias, COUNT(r.id) AS restaurants, MAX(r.rating) AS best
FROM categories c LEFT JOIN restaurants r ON r.category = c.categorias GROUP BY c.categorias"""


@query("f14_run_sql", RUN_SQL.replace("FROM categories", "FROM {categories}").replace("JOIN restaurants", "JOIN {restaurants}"))
def _(t):
    return run_sql(t.spark, _market(t), RUN_SQL + ";")
