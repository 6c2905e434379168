"""Registration of queries: a Spark plan and the SQL it is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlens.plans.derived import DERIVED, RAW
from marketlens.sources.tables import table

_NAME = re.compile(r"\{([a-z]\w*)\}")


# DuckDB's AVG of a decimal differs in its last bit with the plan it gets; the
# quotient of the exact sum and the count does not.
_AVG = re.compile(r"\bAVG\(([\w.]+)\)")


class Tables:
    """Given and derived tables of one data directory, as attributes."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in RAW and name not in DERIVED:
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._load(name)
        return self._frames[name]

    def _load(self, name: str) -> DataFrame:
        if name in RAW:
            return table(self.spark, self.directory, name)
        text = DERIVED[name]
        return self.spark.sql(text, **{used: getattr(self, used) for used in _NAME.findall(text)})


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _with_derived(body: str) -> str:
    """``body`` with the derived tables it names in braces as common table expressions, in order of use."""
    parts: dict[str, str] = {}

    def add(text: str) -> None:
        for name in _NAME.findall(text):
            if name in DERIVED and name not in parts:
                add(DERIVED[name])
                parts[name] = _NAME.sub(r"\1", DERIVED[name])

    add(body)
    plain = _AVG.sub(r"(CAST(SUM(\1) AS DOUBLE) / COUNT(\1))", _NAME.sub(r"\1", body))
    if not parts:
        return plain
    expressions = ",\n".join(f"{name} AS ({text})" for name, text in parts.items())
    return f"WITH {expressions}\n{plain}"


def query(name: str, sql: str | None = None):
    """Register a plan; ``sql`` names tables in braces."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = _with_derived(sql)
        return build

    return register
