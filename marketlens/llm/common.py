"""What several operators share: whole texts, plain lower case, row selection."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text in a partition that is dealt by size.
PART_BYTES = 64 << 20


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` would change other letters too."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def keep_rows(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, key) is in ``kept`` (doc_id, _key, _rows), one row for each pair.

    A row travels as one value beside its pair, so that its own columns may have any names. Pairs that ``kept`` counts once pass
    through a semi join. Of rows that repeat a pair, the one with the smallest other columns stays; only those are aggregated.
    """
    columns = docs.columns
    others = [F.col(name) for name in columns if name != "doc_id"]
    keyed = docs.select(F.col("doc_id").alias("id"), key.alias("key"), F.struct(*others).alias("row"))

    def chosen(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.col("doc_id").alias("other"), F.col("_key").alias("wanted"))
        return keyed.join(pairs, F.col("id").eqNullSafe(F.col("other")) & (F.col("key") == F.col("wanted")), "left_semi")

    once = chosen(kept.where("_rows = 1")).select("id", "row")
    repeated = chosen(kept.where("_rows > 1")).groupBy("id", "key").agg(F.min("row").alias("row")).select("id", "row")
    return once.unionByName(repeated).select(
        *[F.col("id").alias(name) if name == "doc_id" else F.col("row").getField(name).alias(name) for name in columns]
    )


def text_parts(docs: DataFrame, size: int = PART_BYTES) -> int:
    """Into how many partitions whole texts are dealt so that each holds about ``size`` bytes; no fewer than shuffles have."""
    total = docs.agg(F.sum(F.octet_length(whole_text()))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // size))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``docs`` has."""
    taken = {column.lower() for column in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bounded_batches(spark: SparkSession, rows: int = 500, size: int = 8 << 20) -> None:
    """Bound what one Arrow batch hands to a Python worker, in rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
