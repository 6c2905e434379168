"""File imports and exports. Executors read and write; nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.sources.scratch import materialise

CORRUPT = "_corrupt_record"
# The partition column of an imported table: whether its rows are damaged records.
DAMAGED = "_damaged"

# Quotes are doubled inside quoted fields, as CSV readers outside Spark expect.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}
# NULL is written as nothing and the empty text as "". A NULL mark no field can
# hold keeps the two apart when they are read.
CSV_READ_OPTIONS = CSV_OPTIONS | {"nullValue": "\u0001", "emptyValue": "", "enforceSchema": "false"}
# Microseconds, which the default format of text files would cut off.
TIME_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
FORMATS = ("parquet", "orc", "json", "csv")


def to_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**CSV_OPTIONS, **TIME_FORMATS).csv(path)


def to_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line; fields that are NULL are written too."""
    df.write.mode(mode).options(ignoreNullFields="false", **TIME_FORMATS).json(path)


def export_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; use one of {FORMATS}")
    if fmt == "csv":
        to_csv(df, path, mode)
    elif fmt == "json":
        to_json(df, path, mode)
    else:
        df.write.mode(mode).format(fmt).save(path)


def import_table(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: T.StructType,
    multi_line: bool = False,
    target: str | None = None,
    mode: str = "errorifexists",
) -> tuple[DataFrame, DataFrame]:
    """Typed rows of CSV or JSON files, and the raw text of records that do not fit.

    The schema is explicit: no pass over the data to infer it. Rows are parsed
    once, whole: readers of a few columns would otherwise only notice damage in those. With ``target`` that one write is the
    imported table itself (``imported`` reads it again), good and damaged rows in partitions apart; without, it is a table in the shared
    folder. ``multi_line`` is for fields with line breaks; such files cannot be split between tasks.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"unknown import format {fmt!r}; use csv or json")
    read_schema = T.StructType(
        [T.StructField(field.name, field.dataType, True) for field in schema.fields]
        + [T.StructField(CORRUPT, T.StringType(), True)]
    )
    reader = (
        spark.read.schema(read_schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", str(multi_line).lower())
    )
    if fmt == "csv":
        # The header is checked: columns in another order are an error instead
        # of silently swapped.
        rows = reader.options(**CSV_READ_OPTIONS).csv(path)
    else:
        rows = reader.json(path)
    if target is None:
        rows = materialise(rows)
        good = rows.where(F.col(CORRUPT).isNull()).select(schema.fieldNames())
        return good, rows.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("record"))
    parted = rows.withColumn(DAMAGED, F.col(CORRUPT).isNotNull())
    parted.write.mode(mode).partitionBy(DAMAGED).parquet(target)
    return imported(spark, target, schema)


def imported(spark: SparkSession, target: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The typed rows and the damaged records of an imported table; either reads only its own partition."""
    stored = T.StructType(
        [*schema.fields, T.StructField(CORRUPT, T.StringType()), T.StructField(DAMAGED, T.BooleanType())]
    )
    rows = spark.read.schema(stored).parquet(target)
    good = rows.where(~F.col(DAMAGED)).select(schema.fieldNames())
    return good, rows.where(F.col(DAMAGED)).select(F.col(CORRUPT).alias("record"))
