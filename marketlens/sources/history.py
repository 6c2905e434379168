"""The query log as JSON files, and queries that are logged when they run."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from marketlens.schemas import QUERY_LOG
from marketlens.sources.files import to_json
from marketlens.sources.scratch import materialise
from marketlens.sources.tables import run_sql


def read_history(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(QUERY_LOG).json(path)


def append_history(entries: DataFrame, path: str) -> None:
    """Add entries to the log; earlier files are not touched."""
    to_json(entries.select(QUERY_LOG.fieldNames()), path, mode="append")


# Entries that a log keeps.
KEEP = 100


class QueryLog:
    """The log of executed queries in a folder, trimmed to the newest entries.

    ``parts`` has files of entries, ``manifests/N`` names the parts that make up the log. A change writes a new part and the
    next manifest; readers take the newest manifest, so they see the log before a change or after it, never half of one. A
    manifest is created only if it does not exist: of two writers the slower one starts again from what the other left.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = KEEP):
        self.spark = spark
        self.path = path
        self.keep = keep

    def _file(self, name: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _newest(self) -> tuple[int, list[str]]:
        files, folder = self._file("manifests")
        if not files.exists(folder):
            return 0, []
        names = [entry.getPath().getName() for entry in files.listStatus(folder)]
        number = max((int(name) for name in names if name.isdigit()), default=0)
        if not number:
            return 0, []
        text = self.spark.read.text(f"{self.path}/manifests/{number}").collect()
        return number, [row[0] for row in text]

    def _publish(self, number: int, parts: list[str]) -> bool:
        files, target = self._file(f"manifests/{number}")
        try:
            stream = files.create(target, False)
        except Py4JJavaError:
            if files.exists(target):
                return False
            raise
        stream.write(bytearray("\n".join(parts).encode()))
        stream.close()
        return True

    def entries(self) -> DataFrame:
        """The log, at most ``keep`` entries."""
        _, parts = self._newest()
        if not parts:
            return self.spark.createDataFrame([], QUERY_LOG)
        return read_history(self.spark, [f"{self.path}/parts/{part}" for part in parts])

    def append(self, entry: dict) -> None:
        """Add one entry; its id follows the highest. Beyond ``keep`` entries the oldest are left out."""
        while True:
            number, _ = self._newest()
            rows = [row.asDict() for row in self.entries().collect()]
            rows.append({"id": max((row["id"] for row in rows), default=0) + 1, **entry})
            newest = sorted(rows, key=lambda row: row["id"])[-self.keep :]
            part = uuid.uuid4().hex
            frame = self.spark.createDataFrame([Row(**{f.name: row.get(f.name) for f in QUERY_LOG.fields}) for row in newest], QUERY_LOG)
            to_json(frame.coalesce(1), f"{self.path}/parts/{part}")
            if self._publish(number + 1, [part]):
                return


def run_logged(spark: SparkSession, frames: Mapping[str, DataFrame], text: str, log: QueryLog) -> DataFrame:
    """The rows of a query, which is executed here and logged: when, how long, how many rows, and the error if it failed.

    Rows are counted by the job that computes them. A query that fails is logged and raises.
    """
    at, begun = datetime.now(timezone.utc), time.monotonic()
    entry = {"ts": at, "query": text}
    try:
        counted = Observation()
        rows = run_sql(spark, frames, text).observe(counted, F.count(F.lit(1)).alias("rows"))
        result = materialise(rows)
        found = counted.get["rows"]
    except Exception as error:
        log.append({**entry, "execution_time": time.monotonic() - begun, "result_count": 0, "status": "error", "error": str(error)})
        raise
    log.append({**entry, "execution_time": time.monotonic() - begun, "result_count": found, "status": "success", "error": None})
    return result
