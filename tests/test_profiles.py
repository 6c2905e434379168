"""Sketches kept beside a table, and typed columns from JSON texts."""

import glob
import itertools
import os

import pytest
from pyspark.sql import functions as F

from marketlens.operators import properties, stats
from marketlens.sources import sketches

SCHEMA = "id long, text string, price decimal(10,2), ratio double, empty int"


def rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


def make(spark, first, last):
    # A third of all rows share one text.
    ids = spark.range(first, last, 1, 4)
    text = F.when(F.col("id") % 3 == 0, "same").when(F.col("id") % 50 == 1, "").when(F.col("id") % 50 == 2, None)
    return ids.select(
        "id",
        text.otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"),
        F.when(F.col("id") % 7 != 0, F.col("id").cast("decimal(10,2)") / 4).cast("decimal(10,2)").alias("price"),
        (F.col("id") / 8).alias("ratio"),
        F.lit(None).cast("int").alias("empty"),
    )


@pytest.fixture()
def stored(spark, tmp_path):
    path, store = str(tmp_path / "table"), str(tmp_path / "sketches")
    make(spark, 0, 30_000).write.parquet(path)
    schema = spark.read.parquet(path).schema
    return path, schema, store


def test_profile_of_sketches_equals_the_table(spark, stored):
    path, schema, store = stored
    assert sketches.refresh(spark, path, schema, store).count() == 4
    make(spark, 30_000, 40_000).write.mode("append").parquet(path)
    sketches.refresh(spark, path, schema, store)
    table = make(spark, 0, 40_000)
    merged = sketches.profile(spark, path, schema, store)
    audited = {row["column"]: row for row in sketches.audit(table, merged).collect()}
    assert set(audited) == set(table.columns)
    assert all(row["distinct_ok"] and row["quantiles_ok"] for row in audited.values())
    for row in stats.numeric_profile(table).where("column != 'empty'").collect():
        found = audited[row["column"]]
        assert (found["min_value"], found["max_value"], found["mean"]) == (row["min_value"], row["max_value"], row["avg"])
    exact = rows(stats.text_profile(table).drop("distinct"))
    assert rows(sketches.text_profile(merged).drop("distinct")) == exact
    # A column without values.
    empty = audited["empty"]
    assert (empty["nulls"], empty["distinct"], empty["min_value"], empty["mean"], empty["quantiles"]) == (40_000, 0, None, None, None)


def test_known_files_are_not_read_again(spark, stored):
    path, schema, store = stored
    sketches.refresh(spark, path, schema, store)
    before = rows(sketches.profile(spark, path, schema, store))
    # The same name, size and time, but no Parquet any more: reading one of these files would fail.
    for name in glob.glob(f"{path}/*.parquet"):
        at = os.stat(name)
        with open(name, "wb") as file:
            file.write(b"x" * at.st_size)
        os.utime(name, ns=(at.st_atime_ns, at.st_mtime_ns))
    for check in glob.glob(f"{path}/.*.crc"):
        os.remove(check)
    make(spark, 30_000, 31_000).coalesce(1).write.mode("append").parquet(path)
    assert sketches.refresh(spark, path, schema, store).count() == 1
    after = {row["column"]: row for row in sketches.profile(spark, path, schema, store).collect()}
    assert before and after["id"]["rows"] == 31_000 and after["id"]["max_value"] == "30999"


def test_sketches_follow_the_files(spark, stored):
    path, schema, store = stored
    with pytest.raises(sketches.SketchesMissing):
        sketches.profile(spark, path, schema, store)
    sketches.refresh(spark, path, schema, store)
    assert sketches.refresh(spark, path, schema, store).count() == 0
    # Parts stored twice count once.
    parts = spark.read.parquet(store)
    copy = f"{store}-copy"
    parts.unionByName(parts).write.parquet(copy)
    assert rows(sketches.profile(spark, path, schema, copy).select("column", "rows", "mean")) == rows(
        sketches.profile(spark, path, schema, store).select("column", "rows", "mean")
    )
    # Files that are gone leave the profile, new ones must be refreshed first.
    make(spark, 0, 10).coalesce(1).write.mode("overwrite").parquet(path)
    with pytest.raises(sketches.SketchesMissing):
        sketches.profile(spark, path, schema, store)
    sketches.refresh(spark, path, schema, store)
    found = sketches.profile(spark, path, schema, store).where("column = 'id'").first()
    assert (found["rows"], found["distinct"], found["max_value"]) == (10, 10, "9")


def test_table_without_rows(spark, tmp_path):
    path, store = str(tmp_path / "table"), str(tmp_path / "sketches")
    make(spark, 0, 0).write.parquet(path)
    schema = make(spark, 0, 1).schema
    sketches.refresh(spark, path, schema, store)
    found = sketches.profile(spark, path, schema, store).collect()
    assert all(row["rows"] in (None, 0) for row in found)


def test_whole_numbers_beyond_doubles(spark):
    big = 2**53 + 1
    found = stats.numeric_profile(spark.createDataFrame([(big,), (-big,)], "n long")).first()
    assert (found["min_value"], found["max_value"]) == (str(-big), str(big))


@pytest.mark.parametrize(
    "kinds, merged",
    [
        (["BIGINT"], "BIGINT"),
        (["VOID"], "STRING"),
        (["VOID", "BOOLEAN"], "BOOLEAN"),
        (["BIGINT", "DECIMAL(3,2)"], "DECIMAL(21,2)"),
        (["DECIMAL(3,2)", "DECIMAL(5,1)"], "DECIMAL(6,2)"),
        (["DECIMAL(38,0)", "DECIMAL(2,2)"], "DOUBLE"),
        (["BIGINT", "DOUBLE", "VOID"], "DOUBLE"),
        (["BIGINT", "BOOLEAN"], "STRING"),
        (["STRING", "BIGINT", "OBJECT"], "STRING"),
        ([], "STRING"),
    ],
)
def test_types_merge_in_any_order(kinds, merged):
    assert {properties.merge_types(order) for order in itertools.permutations(kinds)} == {merged}


TEXTS = [
    '{"k": 69, "a": 1.50, "b": {"c": [1, 2]}, "o\'x": "q", "s": "5"}',
    "[1]",
    "{bad",
    '{"k": null, "d": 1e3, "t": true}',
    None,
    '{"k": 1, "k": 2}',
    "{}",
    "",
    '{"k": 7, "a": 2, "s": 5, "back\\\\slash": 1}',
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, props string")


EXPECTED = {"a": "DECIMAL(21,2)", "b": "STRING", "d": "DOUBLE", "k": "BIGINT", "o'x": "STRING", "s": "STRING", "t": "BOOLEAN"}


def test_schema_does_not_depend_on_order(texts):
    expected = EXPECTED | {"a": "DECIMAL(20,1)"}
    for frame in (texts, texts.orderBy(F.desc("id")), texts.repartition(5)):
        assert properties.find_schema(frame, "props") == expected
    # Two of nine rows have these keys.
    assert set(properties.find_schema(texts, "props", 0.2)) == {"a", "k", "s"}


def test_typed_properties(texts):
    good, bad = properties.typed_properties(texts, "props", properties.find_schema(texts, "props", 0.2))
    found = {row["id"]: row for row in good.collect()}
    assert rows(bad) == sorted([(i, TEXTS[i]) for i in (1, 2, 4, 5, 7)], key=repr)
    assert found[0]["rest"] == {"b": '{"c":[1,2]}', "o'x": "q"} and (found[0]["k"], found[0]["s"]) == (69, "5")
    assert found[3]["rest"] == {"d": "1000.0", "t": "true"} and found[3]["k"] is None
    assert found[6]["rest"] == {} and (found[6]["a"], found[6]["k"]) == (None, None)
    # A key no path can name stays in the map.
    assert found[8]["rest"] == {"back\\slash": "1"} and found[8]["s"] == "5"


def test_values_of_another_type_stay_in_the_map(texts):
    good, _ = properties.typed_properties(texts, "props", {"s": "BIGINT", "t": "BIGINT"}, prefix="p_")
    found = {row["id"]: row for row in good.collect()}
    assert (found[0]["p_s"], found[0]["rest"]["s"]) == (None, "5")
    assert found[8]["p_s"] == 5 and "s" not in found[8]["rest"]
    assert (found[3]["p_t"], found[3]["rest"]["t"]) == (None, "true")


def test_names_that_exist_already(spark, texts):
    with pytest.raises(ValueError, match="id"):
        properties.typed_properties(texts, "props", {"id": "BIGINT"})
    taken = texts.withColumn("_object", F.lit("mine"))
    good, _ = properties.typed_properties(taken, "props", {"k": "BIGINT"})
    assert {row["_object"] for row in good.collect()} == {"mine"}
    nothing = spark.createDataFrame([], "id int, props string")
    assert properties.find_schema(nothing, "props") == {}
    assert [frame.count() for frame in properties.typed_properties(nothing, "props", {})] == [0, 0]
