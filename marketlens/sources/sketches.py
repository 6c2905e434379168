"""Column profiles from sketches that are kept in files beside a table, one set per file of the table.

A part is one file. Its rows are read once, when it is new; later profiles merge the stored sketches and read no row of
the table. Counts, smallest and largest values and means are exact; distinct counts and quantiles are estimates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.numeric import mean_of, percent
from marketlens.operators import stats
from marketlens.schemas import is_numeric, is_text

# Relative standard error of a distinct count is about 1.04 / sqrt(2 ** LG_K): 1.6 percent. One takes up to 4 KB.
LG_K = 12
# Ranks of quantiles are off by about 0.4 percent. One takes up to 10 KB.
QUANTILE_K = 800
QUANTILES = (0.25, 0.5, 0.75)

PART = ["part", "length", "modified"]


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and time of change of every Parquet file of a table; no file is opened."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    meta = F.col("_metadata")
    return listed.load(path).select(
        meta["file_path"].alias("part"), meta["file_size"].alias("length"), meta["file_modification_time"].alias("modified")
    )


def _sketched(field: T.StructField) -> Column:
    value = F.col(field.name)
    if is_text(field):
        own = [F.count_if(value == "").alias("empty")]
    else:
        whole = isinstance(field.dataType, T.IntegralType)
        own = [
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.sum(value.cast("decimal(20,0)") if whole else value).alias("sum"),
            F.kll_sketch_agg_double(value.cast("double"), F.lit(QUANTILE_K)).alias("ranks"),
        ]
    # Hashed first: decimals and doubles have no distinct sketch of their own.
    hashed = F.when(value.isNotNull(), F.xxhash64(value))
    distinct = F.hll_sketch_agg(hashed, F.lit(LG_K)).alias("values")
    return F.struct(F.count(value).alias("given"), distinct, *own).alias(field.name)


def _profiled(schema: T.StructType) -> list[T.StructField]:
    return [field for field in schema.fields if is_numeric(field) or is_text(field)]


def _stored(spark: SparkSession, store: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(store)


def refresh(spark: SparkSession, path: str, schema: T.StructType, store: str) -> DataFrame:
    """Sketch the files of the table that ``store`` does not have yet, and return their names.

    A file is known by its name, size and time of change, so a replaced file is sketched again. A refresh that fails or
    runs twice adds nothing twice to a profile.
    """
    files, known = _files(spark, path), _stored(spark, store)
    new = files if known is None else files.join(known.select(PART), PART, "left_anti")
    # As many names as files are new; Spark's own listing of the table holds them all on the driver too.
    names = [row["part"] for row in new.select("part").collect()]
    if names:
        meta = F.col("_metadata")
        # The scan lists only these files.
        rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path).where(meta["file_path"].isin(names))
        by_part = rows.groupBy(
            meta["file_path"].alias("part"), meta["file_size"].alias("length"), meta["file_modification_time"].alias("modified")
        )
        counted = by_part.agg(
            F.count(F.lit(1)).alias("rows"), F.struct(*[_sketched(field) for field in _profiled(schema)]).alias("columns")
        )
        counted.write.mode("append").parquet(store)
    return spark.createDataFrame([(name,) for name in names], "part string")


class SketchesMissing(Exception):
    """The table has files the store knows nothing about."""


def _text(value: Column) -> Column:
    return value.cast("string")


def _empty_profile(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [],
        "`column` string, rows long, nulls long, empty long, `distinct` long, min_value string, max_value string, mean double,"
        " quantiles array<double>",
    )


def profile(
    spark: SparkSession, path: str, schema: T.StructType, store: str, quantiles: Sequence[float] = QUANTILES
) -> DataFrame:
    """One row per numeric or text column of the table, merged from the sketches of the files it has now.

    ``rows``, ``nulls``, ``empty`` (empty texts), ``min_value`` and ``max_value`` (as text, exact in the column's own type) and
    ``mean`` are exact, ``distinct`` and ``quantiles`` estimated. Parts without rows and columns without values are
    nothing to merge; what a column has no use for is NULL. Files not refreshed yet raise ``SketchesMissing``.
    """
    files, known = _files(spark, path), _stored(spark, store)
    if known is None:
        if files.isEmpty():
            return _empty_profile(spark)
        raise SketchesMissing(path)
    # Files without rows have no part; their footers say so.
    unknown = files.join(known.select(PART), PART, "left_anti")
    names = [row["part"] for row in unknown.select("part").collect()]
    if names:
        behind = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
        if not behind.where(F.col("_metadata")["file_path"].isin(names)).isEmpty():
            raise SketchesMissing(path)
    # Of a part stored twice one counts.
    parts = known.join(files, PART, "left_semi").dropDuplicates(PART)
    merged = []
    for field in _profiled(schema):
        own = F.col("columns").getField(field.name)
        given = F.sum(own["given"])
        entry = {
            "column": F.lit(field.name),
            "rows": F.sum("rows"),
            "nulls": F.sum(F.col("rows") - own["given"]),
            "empty": F.lit(None).cast("long"),
            "distinct": F.hll_sketch_estimate(F.hll_union_agg(own["values"])),
            "min_value": F.lit(None).cast("string"),
            "max_value": F.lit(None).cast("string"),
            "mean": F.lit(None).cast("double"),
            "quantiles": F.lit(None).cast("array<double>"),
        }
        if is_text(field):
            entry["empty"] = F.sum(own["empty"])
        else:
            ranks = F.kll_merge_agg_double(F.when(own["given"] > 0, own["ranks"]))
            found = F.kll_sketch_get_quantile_double(ranks, F.array(*[F.lit(float(q)) for q in quantiles]))
            entry |= {
                "min_value": _text(F.min(own["min"])),
                "max_value": _text(F.max(own["max"])),
                "mean": mean_of(F.sum(own["sum"]), given),
                "quantiles": F.when(given > 0, found),
            }
        merged.append(F.struct(*[value.alias(name) for name, value in entry.items()]))
    # Bounded: one row.
    return parts.agg(F.array(*merged).alias("_profile")).select(F.inline("_profile"))


def text_profile(profiled: DataFrame) -> DataFrame:
    """The text columns of a merged profile as ``stats.text_profile`` has them, distinct values estimated."""
    missing = F.col("nulls") + F.col("empty")
    return profiled.where("empty IS NOT NULL").select(
        "column", "distinct", F.col("rows").alias("total"), missing.alias("null_empty"),
        percent(F.col("rows") - missing, F.col("rows")).alias("completeness"),
    )


def audit(
    df: DataFrame, profiled: DataFrame, distinct_error: float = 0.08, rank_error: float = 0.02, quantiles: Sequence[float] = QUANTILES
) -> DataFrame:
    """The profile with ``distinct_ok`` and ``quantiles_ok``: whether its estimates hold against the rows of the table.

    A quantile holds if its rank among the values is within ``rank_error`` of the one asked for. Reads the table.
    """
    # Bounded: one row per column.
    found: Mapping[str, list[float] | None] = {row["column"]: row["quantiles"] for row in profiled.collect()}
    held = []
    for name, values in found.items():
        checks = F.lit(True)
        for wanted, value in zip(quantiles, values or []):
            number = F.col(name).cast("double")
            below, upto = F.count_if(number < value), F.count_if(number <= value)
            given = F.count(F.col(name))
            checks = checks & (below <= (wanted + rank_error) * given) & (upto >= (wanted - rank_error) * given)
        held.append(F.struct(F.lit(name).alias("column"), checks.alias("quantiles_ok")))
    ranks = df.agg(F.array(*held).alias("_held")).select(F.inline("_held"))
    kinds = {is_text(field) for field in _profiled(df.schema)}
    exact = [stats.text_profile(df)] * (True in kinds) + [stats.numeric_profile(df)] * (False in kinds)
    counts = reduce(DataFrame.unionByName, [one.select("column", F.col("distinct").alias("_exact")) for one in exact])
    # Columns without values are in no exact profile.
    known = F.coalesce("_exact", F.lit(0))
    near = F.abs(F.col("distinct") - known) <= known * distinct_error
    return profiled.join(ranks, "column").join(counts, "column", "left").withColumn("distinct_ok", near).drop("_exact")
