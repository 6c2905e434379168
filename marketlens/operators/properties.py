"""Columns from a JSON text column whose keys are not known beforehand.

The schema comes from one pass over all rows, counted per key and type before anything moves; it does not depend
on the order of rows. Frequent keys become typed columns, the others stay in a map.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types a value can be found with, of those that are not kept as text.
_DECIMAL = re.compile(r"DECIMAL\((\d+),\s*(\d+)\)")
_SIMPLE = ("BOOLEAN", "DOUBLE")
# Digits of the largest 64-bit integer.
_LONG_DIGITS = 19


def merge_types(types: Iterable[str]) -> str:
    """The one type for values found as ``types``, the same in any order.

    Nulls fit everything. Whole numbers and decimals make a decimal that holds all of them, or a double if a double
    is among them or 38 digits are too few. Booleans stay alone. Anything else, nested values too, is text.
    """
    whole, fraction, kinds = 0, 0, set()
    for kind in types:
        decimal = _DECIMAL.fullmatch(kind)
        if kind == "VOID":
            continue
        if kind == "BIGINT":
            kinds.add("BIGINT")
        elif decimal:
            kinds.add("DECIMAL")
            digits, scale = int(decimal[1]), int(decimal[2])
            whole, fraction = max(whole, digits - scale), max(fraction, scale)
        else:
            kinds.add(kind if kind in _SIMPLE else "STRING")
    if kinds in ({"BIGINT"}, {"BOOLEAN"}):
        return kinds.pop()
    if kinds and kinds <= {"BIGINT", "DECIMAL", "DOUBLE"}:
        if "BIGINT" in kinds:
            whole = max(whole, _LONG_DIGITS)
        if "DOUBLE" in kinds or whole + fraction > 38:
            return "DOUBLE"
        return f"DECIMAL({whole + fraction},{fraction})"
    return "STRING"


def _variant(column: str) -> Column:
    """The text as a variant if it is a JSON object, else NULL."""
    parsed = F.try_parse_json(F.col(column))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT<"), parsed)


def key_types(df: DataFrame, column: str) -> DataFrame:
    """``key``, ``type`` and in how many rows of ``df`` the key has a value of that type."""
    objects = df.select(_variant(column).alias("_object")).where("_object IS NOT NULL")
    entries = df.sparkSession.sql(
        "SELECT key, schema_of_variant(value) AS type FROM {objects}, LATERAL variant_explode(_object)", objects=objects
    )
    # Nested values are text whatever they hold, so their own shapes need no rows here.
    kind = F.regexp_extract("type", r"^(OBJECT|ARRAY)", 1)
    flat = F.when(kind != "", kind).otherwise(F.col("type")).alias("type")
    return entries.groupBy("key", flat).agg(F.count(F.lit(1)).alias("rows"))


def find_schema(df: DataFrame, column: str, min_share: float = 0.01) -> dict[str, str]:
    """Key to type of the keys that at least ``min_share`` of the rows of ``df`` have, in the order of their names.

    The number of keys is bounded by the keys of an average row divided by ``min_share``, however many keys there are in all.
    """
    if not 0 < min_share <= 1:
        raise ValueError("min_share must be above 0 and at most 1")
    per_key = key_types(df, column).groupBy("key").agg(F.sum("rows").alias("rows"), F.collect_set("type").alias("types"))
    total = df.agg(F.count(F.lit(1))).scalar()
    # Bounded: see above.
    found = per_key.where(F.col("rows") >= total * min_share).collect()
    return {row["key"]: merge_types(row["types"]) for row in sorted(found, key=lambda row: row["key"]) if _path(row["key"])}


def _path(key: str) -> str | None:
    """The path of a key, or None for one that no quoting can hold; such keys stay in the map."""
    quote = "'" if "'" not in key else '"'
    return None if quote in key or "\\" in key else f"$[{quote}{key}{quote}]"


def typed_properties(
    df: DataFrame, column: str, schema: Mapping[str, str], prefix: str = "", rest: str = "rest"
) -> tuple[DataFrame, DataFrame]:
    """(rows with a column per key of ``schema`` and the map ``rest`` of all other keys, rows that hold no object as they came).

    A value that does not fit its key's type is NULL in the column and stays in the map as text, as on later rows than
    those the schema comes from. Null texts, texts that are not JSON, values that are no object and objects that name
    a key twice are kept apart. New columns must not have names of ``df``; ``prefix`` goes before them.
    """
    made = {key: f"{prefix}{key}" for key in schema}
    clashes = {name for name in [*made.values(), rest] if name in df.columns} | ({rest} & set(made.values()))
    if clashes:
        raise ValueError(f"columns exist already: {sorted(clashes)}")
    hidden = "_object"
    while hidden in df.columns or hidden in made.values() or hidden == rest:
        hidden += "_"
    parsed = df.withColumn(hidden, _variant(column))
    given = parsed.where(F.col(hidden).isNotNull())
    values, fits = [], {}
    for key, kind in schema.items():
        value = F.try_variant_get(hidden, _path(key), kind)
        # Casts between scalar kinds succeed where the type found differs; only numbers may turn into numbers.
        found = F.schema_of_variant(F.try_variant_get(hidden, _path(key), "variant"))
        right = F.lit(True) if kind == "STRING" else _accepts(kind, found)
        values.append(F.when(right, value).alias(made[key]))
        fits[key] = F.coalesce(found == "VOID", F.lit(False)) | F.coalesce(right & value.isNotNull(), F.lit(False))
    entries = F.map_entries(F.expr(f"try_cast(`{hidden}` AS MAP<STRING, STRING>)"))
    # Keys whose columns hold their values.
    held = F.filter(F.array(*[F.when(ok, F.lit(key)) for key, ok in fits.items()], F.lit(None).cast("string")), lambda k: k.isNotNull())
    others = F.map_from_entries(F.filter(entries, lambda entry: ~F.array_contains(held, entry["key"])))
    good = given.select(*[F.col(f"`{name}`") for name in df.columns], *values, others.alias(rest))
    bad = parsed.where(F.col(hidden).isNull()).select(*[F.col(f"`{name}`") for name in df.columns])
    return good, bad


def _accepts(kind: str, found: Column) -> Column:
    if kind == "BIGINT":
        return found == "BIGINT"
    if kind == "BOOLEAN":
        return found == "BOOLEAN"
    return (found == "BIGINT") | (found == "DOUBLE") | found.startswith("DECIMAL")
