"""Versions of a set of tables as Parquet directories.

A snapshot is written to a directory of its own and listed in the catalogue only
after all its files are in place, so readers never see part of one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOGUE = T.StructType(
    [
        T.StructField("snapshot_id", T.StringType()),
        T.StructField("as_of", T.TimestampType()),
        T.StructField("label", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("checksum", T.StringType()),
    ]
)


class SnapshotDamaged(Exception):
    """Row count or checksum of a table differs from its catalogue entry."""


def _fingerprint(df: DataFrame) -> list[Column]:
    row_hash = F.xxhash64(*[F.col(name) for name in df.columns]).cast("decimal(20,0)")
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(row_hash), F.lit(0).cast("decimal(30,0)")).cast("string").alias("checksum"),
    ]


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and order-independent checksum of a table, in one pass.

    Hashes are summed as decimals: unlike an exclusive or, equal rows do not cancel out.
    """
    return df.agg(*_fingerprint(df))


def _catalogue(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.schema(CATALOGUE).json(f"{directory}/catalogue")


def snapshot(
    tables: Mapping[str, DataFrame],
    directory: str,
    as_of: str,
    label: str = "backup",
    cluster_by: Mapping[str, str] | None = None,
) -> DataFrame:
    """Write all tables as a new snapshot; returns its catalogue entries.

    ``cluster_by`` names a column per table to range-partition and sort the files
    by, so that later filters on it skip files; ``id`` follows it, so that a frequent value is spread over files.
    """
    snapshot_id = "".join(ch if ch.isalnum() else "-" for ch in f"{as_of}-{label}")
    spark = next(iter(tables.values())).sparkSession
    entries = []
    for name, frame in tables.items():
        path = f"{directory}/data/{snapshot_id}/{name}"
        column = (cluster_by or {}).get(name)
        order = [] if column is None else list(dict.fromkeys([column, *({"id"} & set(frame.columns))]))
        written = frame.repartitionByRange(*order).sortWithinPartitions(*order) if order else frame
        # Counted by the tasks that write, of which only successful ones count; ``verify`` reads the files.
        counted = Observation()
        written.observe(counted, *_fingerprint(frame)).write.mode("errorifexists").parquet(path)
        found = counted.get
        entries.append((snapshot_id, as_of, label, name, found["rows"], found["checksum"]))
    # Bounded: one row per table.
    listed = spark.createDataFrame(entries, "snapshot_id string, as_of string, label string, table string, rows long, checksum string")
    listed.withColumn("as_of", F.col("as_of").cast("timestamp")).coalesce(1).write.mode("append").json(f"{directory}/catalogue")
    return _catalogue(spark, directory).where(F.col("snapshot_id") == snapshot_id)


def list_snapshots(spark: SparkSession, directory: str, n: int = 10) -> DataFrame:
    """The newest snapshots with their tables and rows."""
    return (
        _catalogue(spark, directory)
        .groupBy("snapshot_id", "as_of", "label")
        .agg(F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows"))
        .orderBy(F.desc("as_of"), F.desc("snapshot_id"))
        .limit(n)
    )


def read_snapshot(
    spark: SparkSession, directory: str, snapshot_id: str, tables: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """The snapshot's tables, unverified."""
    listed = _catalogue(spark, directory).where(F.col("snapshot_id") == snapshot_id).select("table")
    # Bounded: one row per table.
    names = [row["table"] for row in listed.collect()]
    if not names:
        raise KeyError(f"no snapshot {snapshot_id!r} in {directory}")
    wanted = names if tables is None else [name for name in names if name in tables]
    return {name: spark.read.parquet(f"{directory}/data/{snapshot_id}/{name}") for name in wanted}


def verify(spark: SparkSession, directory: str, snapshot_id: str) -> DataFrame:
    """Tables of a snapshot whose files no longer match the catalogue."""
    frames = read_snapshot(spark, directory, snapshot_id)
    found = reduce(
        DataFrame.unionByName,
        [
            fingerprint(frame).select(
                F.lit(name).alias("table"), F.col("rows").alias("found_rows"), F.col("checksum").alias("found_checksum")
            )
            for name, frame in frames.items()
        ],
    )
    listed = _catalogue(spark, directory).where(F.col("snapshot_id") == snapshot_id)
    differs = (F.col("rows") != F.col("found_rows")) | (F.col("checksum") != F.col("found_checksum"))
    return listed.join(found, "table").where(differs)


def restore(
    spark: SparkSession, directory: str, snapshot_id: str, current: Mapping[str, DataFrame], as_of: str
) -> dict[str, DataFrame]:
    """The verified tables of a snapshot, after the current tables were put into one of their own."""
    # Bounded: at most one row per table.
    damaged = [row["table"] for row in verify(spark, directory, snapshot_id).collect()]
    if damaged:
        raise SnapshotDamaged(f"snapshot {snapshot_id}: {', '.join(sorted(damaged))}")
    if current:
        snapshot(current, directory, as_of, label="pre-restore")
    return read_snapshot(spark, directory, snapshot_id)


def diff_tables(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Keys added to, removed from or changed in ``b`` compared with ``a``.

    NULLs compare as values. Only the key and one flag per side leave the join.
    """
    common = [name for name in a.columns if name != key and name in b.columns]
    left = a.select(key, F.struct(*[F.col(n) for n in common]).alias("_a"))
    right = b.select(key, F.struct(*[F.col(n) for n in common]).alias("_b"))
    change = (
        F.when(F.col("_a").isNull(), "added")
        .when(F.col("_b").isNull(), "removed")
        .when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    )
    return left.join(right, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")
