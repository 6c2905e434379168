"""Files, snapshots and the stream."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.operators import ingest
from marketlens.plans.registry import Tables
from marketlens.sources import files, history, snapshots
from marketlens.sources.tables import run_sql
from marketlens.sources import scratch
from marketlens.streaming.ingest import stream_ingest, table_so_far

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SMALL)


def rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


AWKWARD = [(1, 'say "hi", ok', "2024-01-01 10:20:30.123456"), (2, "", None), (3, None, None), (4, "a;b\tc", None), (5, "N/A", None)]


@pytest.fixture()
def awkward(spark):
    return spark.createDataFrame(AWKWARD, "id int, text string, t string").withColumn("t", F.col("t").cast("timestamp"))


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_text_formats_keep_values(spark, awkward, tmp_path, fmt):
    path = str(tmp_path / "out")
    files.export_table(awkward, path, fmt)
    good, bad = files.import_table(spark, path, fmt, awkward.schema)
    assert rows(good) == rows(awkward) and bad.count() == 0


def test_csv_with_line_breaks(spark, tmp_path):
    frame = spark.createDataFrame([(1, "two\nlines"), (2, "one")], "id int, text string")
    files.to_csv(frame, str(tmp_path / "out"))
    good, _ = files.import_table(spark, str(tmp_path / "out"), "csv", frame.schema, multi_line=True)
    assert rows(good) == rows(frame)


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_binary_formats_keep_values(spark, awkward, tmp_path, fmt):
    files.export_table(awkward, str(tmp_path / "out"), fmt)
    assert rows(spark.read.format(fmt).load(str(tmp_path / "out"))) == rows(awkward)


def test_import_keeps_damaged_records_apart(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,n\n1,5\n2,many\n3,7\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("n", T.IntegerType())])
    good, bad = files.import_table(spark, str(tmp_path / "in.csv"), "csv", schema)
    # Also when only undamaged columns are looked at.
    assert rows(good.select("id")) == [(1,), (3,)]
    assert rows(bad) == [("2,many",)]
    with pytest.raises(ValueError):
        files.import_table(spark, "x", "xlsx", schema)
    with pytest.raises(ValueError):
        files.export_table(good, "x", "xlsx")


def test_import_into_a_target(spark, tmp_path, monkeypatch):
    (tmp_path / "in.csv").write_text("id,n\n1,5\n2,many\n3,7\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("n", T.IntegerType())])
    monkeypatch.setattr(files, "materialise", None)  # no second copy
    target = str(tmp_path / "table")
    good, bad = files.import_table(spark, str(tmp_path / "in.csv"), "csv", schema, target=target)
    assert rows(good.select("id")) == [(1,), (3,)] and rows(bad) == [("2,many",)]
    assert good.schema == schema
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_damaged" in plan and "PushedFilters: []" in plan
    with pytest.raises(Exception, match="(?i)exists"):
        files.import_table(spark, str(tmp_path / "in.csv"), "csv", schema, target=target)
    (tmp_path / "in.csv").write_text("id,n\n")
    files.import_table(spark, str(tmp_path / "in.csv"), "csv", schema, target=target, mode="overwrite")
    assert [frame.count() for frame in files.imported(spark, target, schema)] == [0, 0]


def test_import_checks_the_header(spark, tmp_path):
    (tmp_path / "in.csv").write_text("n,id\n1,5\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("n", T.IntegerType())])
    with pytest.raises(Exception, match="(?i)header"):
        files.import_table(spark, str(tmp_path / "in.csv"), "csv", schema)


def test_history_appends(spark, tables, tmp_path):
    path = str(tmp_path / "log")
    history.append_history(tables.history.limit(10), path)
    history.append_history(tables.history.limit(5), path)
    assert history.read_history(spark, path).count() == 15


def test_run_sql_takes_a_semicolon(spark, tables):
    assert run_sql(spark, {"r": tables.restaurants}, " SELECT count(*) AS n FROM r ; ").first()["n"] == 150


def test_snapshot_life(spark, tables, tmp_path):
    directory = str(tmp_path)
    market = {"restaurants": tables.restaurants, "categories": tables.categories}
    entries = snapshots.snapshot(market, directory, "2024-01-30", cluster_by={"restaurants": "city"})
    snapshot_id = entries.first()["snapshot_id"]
    assert {r["table"]: r["rows"] for r in entries.collect()} == {"restaurants": 150, "categories": 5}
    current = {"restaurants": tables.restaurants.where("id < 10")}
    restored = snapshots.restore(spark, directory, snapshot_id, current, "2024-01-31")
    assert rows(restored["restaurants"]) == rows(tables.restaurants)
    listed = [(r["label"], r["tables"], r["rows"]) for r in snapshots.list_snapshots(spark, directory).collect()]
    assert listed == [("pre-restore", 1, 10), ("backup", 2, 155)]
    with pytest.raises(KeyError):
        snapshots.read_snapshot(spark, directory, "none")
    # A table that gained a row no longer matches its entry.
    tables.categories.limit(1).write.mode("append").parquet(f"{directory}/data/{snapshot_id}/categories")
    assert [r["table"] for r in snapshots.verify(spark, directory, snapshot_id).collect()] == ["categories"]
    with pytest.raises(snapshots.SnapshotDamaged):
        snapshots.restore(spark, directory, snapshot_id, current, "2024-02-01")


def test_fingerprint_sees_repeated_rows(spark):
    one = spark.createDataFrame([(1, None)], "a int, b string")
    assert snapshots.fingerprint(one).first() != snapshots.fingerprint(one.union(one).union(one)).first()
    assert tuple(snapshots.fingerprint(one.limit(0)).first()) == (0, "0")


def test_diff_compares_nulls_as_values(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id int, v string")
    b = spark.createDataFrame([(1, None), (2, None), (4, "z")], "id int, v string")
    assert rows(snapshots.diff_tables(a, b)) == [(2, "changed"), (3, "removed"), (4, "added")]


def _insert(known, batch):
    return ingest.insert_new_restaurants(known, ingest.parse_cards(batch, "https://e.com", "2024-01-31"))


def test_stream_equals_batch(spark, tables, tmp_path):
    """Files arriving in four portions, the stream stopped and started between them."""
    cards, known = tables.staging, tables.known_restaurants
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))

    def run():
        stream_ingest(spark, source, out, checkpoint, cards.schema, known, _insert, max_files_per_trigger=1).awaitTermination()

    for portion in range(4):
        low, high = portion * 400, portion * 400 + 400
        cards.where(f"pos >= {low} AND pos < {high}").coalesce(1).write.mode("append").parquet(source)
        if portion != 1:
            run()
    streamed = table_so_far(spark, out, known.schema)
    expected = known.unionByName(_insert(known, cards))
    assert rows(streamed) == rows(expected)
    run()
    assert table_so_far(spark, out, known.schema).count() == streamed.count()


def test_repeated_micro_batch_changes_nothing(spark, tables, tmp_path):
    """A batch that is run again after its output was written gives the same table."""
    cards, known = tables.staging, tables.known_restaurants
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    cards.coalesce(1).write.parquet(source)
    for _ in range(2):
        stream_ingest(spark, source, out, checkpoint, cards.schema, known, _insert).awaitTermination()
        # As if the driver was lost before the batch was committed.
        for name in ("0", ".0.crc"):
            (tmp_path / "checkpoint" / "commits" / name).unlink()
    assert rows(table_so_far(spark, out, known.schema)) == rows(known.unionByName(_insert(known, cards)))


def test_new_checkpoint_is_refused(spark, tables, tmp_path):
    """With a fresh checkpoint batch 0 would overwrite one part of the table and leave the others."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    known, cards = tables.known_restaurants, tables.staging
    cards.repartition(2).write.parquet(source)
    old = str(tmp_path / "old")
    stream_ingest(spark, source, out, old, cards.schema, known, _insert, max_files_per_trigger=1).awaitTermination()
    expected = rows(table_so_far(spark, out, known.schema))
    with pytest.raises(ValueError):
        stream_ingest(spark, source, out, str(tmp_path / "new"), cards.schema, known, _insert)
    stream_ingest(spark, source, out, old, cards.schema, known, _insert).awaitTermination()
    assert rows(table_so_far(spark, out, known.schema)) == expected
    assert len({row[0] for row in expected}) == len(expected)


def test_scratch_tables_have_owners(spark, tmp_path):
    with scratch.scratch_scope(spark):
        table = scratch.materialise(spark.range(5))
        path = table.inputFiles()[0].rsplit("/", 1)[0]
        assert table.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())
