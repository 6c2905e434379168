"""Ingest of arriving files with the functions of the batch path."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marketlens.sources.scratch import scratch_scope
from marketlens.streaming.state import KeyState, exists, mark

BATCH = "ingest_batch"
SEED = -1
# Marks in the output folder; readers of Parquet skip such names.
SEEDED = "_ingest_seeded"
OWNER = "_ingest_owner"


def _claim(spark: SparkSession, out_dir: str, checkpoint: str) -> str | None:
    """The stream that owns ``out_dir``, None if there is none yet; raises if it is not the checkpoint's."""
    known = f"{checkpoint}/metadata"
    mine = json.loads(spark.read.text(known).first()[0])["id"] if exists(spark, known) else None
    if not exists(spark, f"{out_dir}/{OWNER}"):
        # Begun but not marked, if the driver was lost right after the start.
        if mine is None and exists(spark, f"{out_dir}/{BATCH}=0"):
            raise ValueError(f"{out_dir} holds batches that checkpoint {checkpoint} does not know")
        return None
    owner = spark.read.text(f"{out_dir}/{OWNER}").first()[0]
    if owner != mine:
        raise ValueError(f"{out_dir} holds batches that checkpoint {checkpoint} does not know")
    return owner


def table_so_far(spark: SparkSession, out_dir: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The ingested table; with ``before``, as it was before that micro-batch."""
    stored = T.StructType(list(schema.fields) + [T.StructField(BATCH, T.IntegerType())])
    rows = spark.read.schema(stored).option("basePath", out_dir).parquet(out_dir)
    if before is not None:
        # A partition column: batches from here on are not read.
        rows = rows.where(F.col(BATCH) < before)
    return rows.select(schema.fieldNames())


def stream_ingest(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    staging_schema: T.StructType,
    existing: DataFrame,
    insert: Callable[[DataFrame, DataFrame], DataFrame],
    max_files_per_trigger: int | None = None,
    state: KeyState | None = None,
    parse: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Process all files that have arrived in ``in_dir``, then stop.

    ``insert(table, batch)`` gives the new rows of a batch, e.g. parsing followed by
    ``insert_new_restaurants``. Each micro-batch writes one partition of ``out_dir``
    and reads only earlier ones: repeating a batch after a failure gives the same
    rows in the same place. ``existing`` is written as the first partition of a new
    ``out_dir``; later calls find it there. An ``out_dir`` belongs to the checkpoint it was
    begun with: with another or a new one, whose batches would be numbered from 0 again, the call raises.

    With ``state``, which is kept in ``out_dir``, a batch does not read the table: ``insert`` is given only what
    it needs to compare keys and to continue ids (``KeyState.known``). ``parse`` makes a batch's key columns. A table that was
    begun without gets its state from one last read.
    """
    schema = existing.schema
    owner = _claim(spark, out_dir, checkpoint)
    if owner is None and not exists(spark, f"{out_dir}/{SEEDED}"):
        existing.write.mode("overwrite").parquet(f"{out_dir}/{BATCH}={SEED}")
        # Written when the seed is complete, and by us: not every committer leaves a mark of its own.
        mark(spark, f"{out_dir}/{SEEDED}", "seeded")

    def save(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        target = f"{out_dir}/{BATCH}={batch_id}"
        with scratch_scope(session):
            if state is None:
                before = table_so_far(session, out_dir, schema, before=batch_id)
            else:
                if state.base(session, batch_id) is None:
                    state.start(table_so_far(session, out_dir, schema, before=batch_id), batch_id)
                before = state.known(batch if parse is None else parse(batch), batch_id)
            insert(before, batch).write.mode("overwrite").parquet(target)
            if state is not None:
                state.add(session.read.schema(schema).parquet(target), batch_id)

    reader = spark.readStream.schema(staging_schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = (
        reader.parquet(in_dir)
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    if owner is None:
        mark(spark, f"{out_dir}/{OWNER}", stream.id)
    return stream
