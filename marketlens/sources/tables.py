"""Tables by name, and queries over a set of them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Full scan of one Parquet table; filters and column choice reach the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def tables(spark: SparkSession, directory: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: table(spark, directory, name) for name in names}


def run_sql(spark: SparkSession, frames: Mapping[str, DataFrame], text: str) -> DataFrame:
    """Any SQL query over the given tables; one trailing ``;`` is allowed.

    The names are views only while the query is resolved; views of the session that have them come back after it.
    """
    catalog = spark.catalog
    hidden = {
        name: spark.table(name) for name in frames if catalog.tableExists(name) and catalog.getTable(name).isTemporary
    }
    try:
        for name, frame in frames.items():
            frame.createOrReplaceTempView(name)
        return spark.sql(text.strip().removesuffix(";"))
    finally:
        for name in frames:
            if name in hidden:
                hidden[name].createOrReplaceTempView(name)
            else:
                catalog.dropTempView(name)
