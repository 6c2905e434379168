"""Schema evolution: missing columns, the migration ledger, references between tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.operators.ingest import assign_ids
from marketlens.operators.joins import orphans
from marketlens.operators.quality import orphan_rule

NO_VERSION = "0.0.0"


def add_missing(df: DataFrame, columns: Mapping[str, str | T.DataType]) -> DataFrame:
    """Add the columns the table lacks, filled with NULL."""
    absent = {name: F.lit(None).cast(kind) for name, kind in columns.items() if name not in df.columns}
    return df.withColumns(absent) if absent else df


def drop_table(tables: Mapping[str, DataFrame], name: str) -> dict[str, DataFrame]:
    if name not in tables:
        raise KeyError(f"no table {name!r}")
    return {other: frame for other, frame in tables.items() if other != name}


# --- migrations -------------------------------------------------------------


def current_version(ledger: DataFrame) -> DataFrame:
    """Version applied last; ``0.0.0`` before any."""
    latest = F.max_by("version", F.struct("applied_at", "id"))
    return ledger.agg(F.coalesce(latest, F.lit(NO_VERSION)).alias("version"))


def pending(defined: DataFrame, ledger: DataFrame) -> DataFrame:
    """Defined migrations (version, description, text) that are not in the ledger."""
    return defined.join(ledger.select("version").distinct(), "version", "left_anti").select(defined.columns)


def record(ledger: DataFrame, applied: DataFrame, as_of: str) -> DataFrame:
    """The ledger with the applied migrations added, each with the MD5 of its text."""
    rows = applied.select(
        "version",
        "description",
        F.lit(as_of).cast("timestamp").alias("applied_at"),
        F.md5(F.encode("text", "UTF-8")).alias("checksum"),
    )
    numbered = assign_ids(rows, ledger, ("version",))
    return ledger.unionByName(numbered.select([F.col(f.name).cast(f.dataType) for f in ledger.schema.fields]))


@dataclass(frozen=True)
class Migration:
    version: str
    description: str
    text: str
    change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


def _audit_columns(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    audited = ("restaurants", "products", "categories")
    return {
        name: add_missing(frame, {"updated_at": "timestamp"}) if name in audited else frame
        for name, frame in tables.items()
    }


MIGRATIONS = [
    Migration("1.0.0", "Base tables", "categories, restaurants, products", dict),
    Migration("1.2.0", "Audit columns", "add updated_at to restaurants, products, categories", _audit_columns),
]


def migrate(
    tables: Mapping[str, DataFrame], ledger: DataFrame, as_of: str, migrations: list[Migration] = MIGRATIONS
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables after the pending migrations, ledger with them recorded)."""
    spark = ledger.sparkSession
    defined = spark.createDataFrame(
        [(m.version, m.description, m.text) for m in migrations], "version string, description string, text string"
    )
    todo = pending(defined, ledger)
    # Bounded: the migrations defined in code.
    versions = {row["version"] for row in todo.select("version").collect()}
    changed = dict(tables)
    for migration in migrations:
        if migration.version in versions:
            changed = migration.change(changed)
    return changed, record(ledger, todo, as_of)


# --- references -------------------------------------------------------------


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` refers to ``parent.key``; checked on demand, Spark does not enforce it."""

    child: str
    column: str
    parent: str
    key: str = "id"

    def violations(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        return orphans(tables[self.child], self.column, tables[self.parent], self.key)

    def count(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        return orphan_rule(tables[self.child], self.column, tables[self.parent], self.key)


def fk(child: str, column: str, parent: str, key: str = "id") -> ForeignKey:
    return ForeignKey(child, column, parent, key)
