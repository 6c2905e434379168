"""Keys of a growing table, kept beside it so that a micro-batch need not read the table.

``bases/before=B`` has the keys and ids of all batches before B, ``deltas/batch=N`` those that batch N added, both in
buckets by the key's hash; ``highest/batch=N`` has the highest id up to and with batch N. A micro-batch reads the
buckets of its own keys from the newest base that is complete and the deltas after it. Whatever batch N writes is
overwritten when N is repeated, and N reads only what earlier ones wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The folder in the output folder; readers of Parquet skip such names.
FOLDER = "_ingest_keys"
BUCKETS = 64
# Batches after which the deltas are merged into a new base.
MERGE_AFTER = 16


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a path of any file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = hadoop_path(spark, path)
    return files.exists(target)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    files, target = hadoop_path(spark, path)
    return [entry.getPath().getName() for entry in files.listStatus(target)] if files.exists(target) else []


def mark(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


class KeyState:
    """Known keys of the table in ``out_dir``; ``key`` maps key columns to how they are compared, ``schema`` is the table's."""

    def __init__(
        self,
        out_dir: str,
        key: dict[str, Callable[[str], Column]],
        schema: T.StructType,
        id_column: str = "id",
        buckets: int = BUCKETS,
        merge_after: int = MERGE_AFTER,
    ):
        self.root = f"{out_dir}/{FOLDER}"
        self.key = key
        self.schema = schema
        self.id_column = id_column
        self.buckets = buckets
        self.merge_after = merge_after
        kinds = [T.StructField(name, schema[name].dataType) for name in key]
        self.stored = T.StructType([*kinds, T.StructField(id_column, schema[id_column].dataType)])

    def _keyed(self, rows: DataFrame) -> DataFrame:
        """Rows with complete keys, as they are compared, and their bucket."""
        made = {name: make(name).cast(self.schema[name].dataType) for name, make in self.key.items()}
        others = [self.id_column] if self.id_column in rows.columns else []
        keyed = rows.select(*[value.alias(name) for name, value in made.items()], *others).dropna(subset=list(self.key))
        return keyed.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, keyed: DataFrame, path: str) -> None:
        keyed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def _bases(self, spark: SparkSession) -> list[int]:
        return sorted(int(name.split("-")[1]) for name in names_in(spark, f"{self.root}/complete"))

    def base(self, spark: SparkSession, batch: int) -> int | None:
        """The newest complete base a batch may read."""
        return max((b for b in self._bases(spark) if b <= batch), default=None)

    def start(self, table: DataFrame, batch: int) -> None:
        """Make the first base from the table as it was before ``batch``."""
        spark = table.sparkSession
        highest = table.agg(F.max(self.id_column).alias(self.id_column))
        highest.write.mode("overwrite").parquet(f"{self.root}/highest/batch={batch - 1}")
        self._complete(spark, self._keyed(table), batch)

    def _complete(self, spark: SparkSession, keyed: DataFrame, batch: int) -> None:
        self._write(keyed, f"{self.root}/bases/before={batch}")
        mark(spark, f"{self.root}/complete/before-{batch}", "complete")

    def keys(self, spark: SparkSession, batch: int) -> DataFrame:
        """Keys, ids and buckets of all batches before ``batch``; a filter on ``bucket`` keeps other buckets unread."""
        base = self.base(spark, batch)
        schema = T.StructType([*self.stored.fields, T.StructField("bucket", T.IntegerType())])
        found = spark.read.schema(schema).parquet(f"{self.root}/bases/before={base}")
        later = [
            f"{self.root}/deltas/batch={n}"
            for n in sorted(int(name.split("=")[1]) for name in names_in(spark, f"{self.root}/deltas") if "=" in name)
            if base <= n < batch
        ]
        for path in later:
            found = found.unionByName(spark.read.schema(schema).parquet(path))
        return found

    def known(self, rows: DataFrame, batch: int) -> DataFrame:
        """What an insert needs of the table before ``batch``, in its schema: its rows in the buckets of the keys of ``rows``, with
        no other columns than key and id filled, and a row with the highest id and no key."""
        spark = rows.sparkSession
        # At most as many numbers as there are buckets.
        wanted = [row[0] for row in self._keyed(rows).select("bucket").distinct().collect()]
        near = self.keys(spark, batch).where(F.col("bucket").isin(wanted))
        highest = spark.read.schema(T.StructType([self.stored[self.id_column]])).parquet(f"{self.root}/highest/batch={batch - 1}")
        found = near.unionByName(highest, allowMissingColumns=True)
        return found.select(
            *[F.col(f.name) if f.name in self.stored.names else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        )

    def add(self, added: DataFrame, batch: int) -> None:
        """Keep the keys and the highest id of the rows that ``batch`` has written."""
        spark = added.sparkSession
        self._write(self._keyed(added), f"{self.root}/deltas/batch={batch}")
        before = spark.read.parquet(f"{self.root}/highest/batch={batch - 1}")
        highest = before.unionByName(added.select(self.id_column)).agg(F.max(self.id_column).alias(self.id_column))
        highest.write.mode("overwrite").parquet(f"{self.root}/highest/batch={batch}")
        if batch + 1 - self.base(spark, batch) >= self.merge_after:
            self._complete(spark, self.keys(spark, batch + 1), batch + 1)
