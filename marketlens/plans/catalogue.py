"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlens.plans import (  # noqa: F401  (registration)
    change_queries,
    filter_queries,
    ingest_queries,
    log_queries,
    quality_queries,
    report_queries,
    source_queries,
    stats_queries,
    time_queries,
)
from marketlens.plans.registry import ORACLES, QUERIES, Tables
from marketlens.session import adopt


def _callable(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        adopt(spark)
        return build(Tables(spark, directory))

    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _callable(build) for name, build in QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
