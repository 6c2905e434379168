"""Rows that arrive out of order: kept once, late ones apart.

Before each micro-batch the watermark is the latest time of all earlier batches less a delay. Rows before it are late and go
to a table of their own; the others are kept if no row with their key has been kept since the watermark. Keys are
remembered in spans of their time, so a micro-batch reads the spans from its watermark on and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marketlens.sources.scratch import materialise, scratch_scope
from marketlens.streaming.state import names_in

KEPT, LATE, _SEEN, _LATEST = "kept", "late", "_seen", "_latest"
# Keys are remembered in spans of time of so many seconds.
SPAN = 6 * 3600


def _stored(spark: SparkSession, path: str, schema: T.StructType, before: int) -> DataFrame:
    """Rows that batches before this one have written."""
    names = [name for name in names_in(spark, path) if name.startswith("batch=") and int(name.split("=")[1]) < before]
    found = spark.read.schema(schema)
    return found.option("basePath", path).parquet(*[f"{path}/{name}" for name in names]) if names else spark.createDataFrame([], schema)


def arrived(spark: SparkSession, out_dir: str, schema: T.StructType, which: str = KEPT) -> DataFrame:
    """The table of rows kept, or of late ones, so far."""
    return _stored(spark, f"{out_dir}/{which}", schema, 1 << 62).select(schema.fieldNames())


def stream_arrivals(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    schema: T.StructType,
    key: str,
    time: str,
    delay: int,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Process all files that have arrived, then stop; ``delay`` is in seconds.

    Of rows with one key in a batch the earliest stays, then the one with the smallest other columns. Rows
    without a time are late, as their place is unknown; those without a key are no copies of each other. A repeated
    batch reads what earlier ones left and overwrites its own output.
    """
    seen = T.StructType([T.StructField("key", schema[key].dataType), T.StructField("span", T.LongType())])
    latest = T.StructType([T.StructField("latest", T.LongType())])

    def save(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        with scratch_scope(session):
            rows = materialise(batch.withColumn("_at", F.unix_micros(F.col(time).cast("timestamp"))))
            top = _stored(session, f"{out_dir}/{_LATEST}", latest, number).agg(F.max("latest")).first()[0]
            mark = -(1 << 62) if top is None else top - delay * 1_000_000
            late = F.col("_at").isNull() | (F.col("_at") < mark)
            rows.where(late).drop("_at").write.mode("overwrite").parquet(f"{out_dir}/{LATE}/batch={number}")
            timely = rows.where(~late)
            others = [F.col(name) for name in schema.fieldNames() if name != key]
            first = Window.partitionBy(key).orderBy("_at", *others)
            once = timely.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
            # The span of the watermark holds keys from before it too; they are told apart by their time.
            floor = F.lit(mark // (SPAN * 1_000_000))
            known = _stored(session, f"{out_dir}/{_SEEN}", T.StructType([*seen.fields, T.StructField("at", T.LongType())]), number)
            known = known.where((F.col("span") >= floor) & (F.col("at") >= mark)).select(F.col("key").alias("_key"))
            fresh = once.join(known, F.col(key) == F.col("_key"), "left_anti")
            kept = materialise(fresh.unionByName(timely.where(F.col(key).isNull())))
            kept.drop("_at").write.mode("overwrite").parquet(f"{out_dir}/{KEPT}/batch={number}")
            span = F.floor(F.col("_at") / (SPAN * 1_000_000)).alias("span")
            remembered = kept.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col("_at").alias("at"), span)
            remembered.repartition("span").write.mode("overwrite").partitionBy("span").parquet(f"{out_dir}/{_SEEN}/batch={number}")
            rows.agg(F.max("_at").alias("latest")).write.mode("overwrite").parquet(f"{out_dir}/{_LATEST}/batch={number}")

    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    writer = reader.parquet(in_dir).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
