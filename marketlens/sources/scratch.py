"""Shared storage for intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
# Paths written since the innermost open scope of this thread began.
_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a session whose master is ``local[...]`` may do without the setting and
    gets a temporary folder; any other raises, since executors of a cluster do
    not see each other's disks.
    """
    context = spark.sparkContext
    configured = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if configured is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError(f"set {SETTING} to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="marketlens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder nothing has been written to, owned by the innermost open scope."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    owned = _OWNED.get()
    if owned is not None:
        owned.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder, whatever its file system; a missing one is no error."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Own every table written inside the block and delete all of them at its end.

    Frames that read those tables must have been written or collected by then.
    """
    paths: list[str] = []
    token = _OWNED.set(paths)
    try:
        yield
    finally:
        _OWNED.reset(token)
        for path in paths:
            delete(spark, path)


def materialise(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder, so that every later use sees the same rows.

    A lost executor costs a re-read of some of its files, not a recomputation, and
    a later use of few columns reads only those. Inside ``scratch_scope`` the table
    is deleted when the scope ends; outside it stays for the folder's retention rule.
    """
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
