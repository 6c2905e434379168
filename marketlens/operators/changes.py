"""Row changes: each returns the next version of a table, which is written as a new snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.checks import is_valid
from marketlens.functions.literals import days_before, typed
from marketlens.functions.parse import strip
from marketlens.operators.ingest import assign_ids
from marketlens.operators.joins import orphan_keys, reference_count
from marketlens.operators.lookup import lookup_join
from marketlens.sources.scratch import materialise

# --- insert -----------------------------------------------------------------

TRUE_WORDS = ["true", "1", "sim", "s"]


def _type_word(data_type: T.DataType) -> str:
    if isinstance(data_type, T.IntegralType):
        return "INTEGER"
    if isinstance(data_type, T.DecimalType):
        return "DECIMAL"
    return {T.BooleanType: "BOOLEAN", T.DateType: "DATE"}.get(type(data_type), "TEXT")


def _parsed(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.BooleanType):
        return F.when(value.isNotNull(), F.lower(value).isin(TRUE_WORDS))
    if isinstance(data_type, T.NumericType):
        return strip(value).try_cast(data_type)
    return value.try_cast(data_type)


def insert(df: DataFrame, rows: DataFrame, schema: T.StructType, order: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(table with the valid rows added, rejected rows as they came).

    ``rows`` are texts, one column per schema column but the key; a column they
    lack is NULL. Ids continue in the order of the unique column ``order``.
    """
    fields = [field for field in schema.fields if field.name != key]
    checked = rows
    accepted = F.lit(True)
    typed = [F.col(order)]
    for field in fields:
        value = F.col(field.name) if field.name in rows.columns else F.lit(None).cast("string")
        parsed = _parsed(value, field.dataType)
        usable = is_valid(value, _type_word(field.dataType)) & parsed.isNotNull()
        accepted = accepted & (usable | (value.isNull() & F.lit(field.nullable)))
        typed.append(parsed.alias(field.name))
    good = checked.where(accepted).select(typed)
    added = assign_ids(good, df, (order,), key).select([F.col(f.name).cast(f.dataType) for f in df.schema.fields])
    return df.unionByName(added), checked.where(~accepted)


# Example rows of five tables, by column.
SAMPLES = {
    "restaurants": (
        ["name", "category", "rating", "delivery_time", "delivery_fee", "city"],
        [
            ["Burger King", "Fast Food", "4.2", "25", "5.99", "São Paulo"],
            ["McDonald's", "Fast Food", "4.0", "20", "4.99", "São Paulo"],
            ["Pizza Hut", "Pizza", "4.5", "35", "7.99", "Rio de Janeiro"],
            ["Subway", "Sanduíches", "4.1", "15", "3.99", "São Paulo"],
            ["KFC", "Fast Food", "4.3", "30", "6.99", "Rio de Janeiro"],
        ],
    ),
    "dishes": (
        ["restaurant_id", "name", "description", "price", "category", "available"],
        [
            ["1", "Big King", "Hambúrguer artesanal", "15.99", "Hambúrgueres", "true"],
            ["1", "Batata Frita", "Batata sequinha", "8.99", "Acompanhamentos", "true"],
            ["2", "Big Mac", "Hambúrguer clássico", "16.99", "Hambúrgueres", "true"],
            ["3", "Pizza Pepperoni", "Pizza tradicional", "35.99", "Pizzas", "true"],
            ["4", "Subway Frango", "Sanduíche de frango", "12.99", "Sanduíches", "true"],
        ],
    ),
    "promotions": (
        ["restaurant_id", "title", "description", "discount_percentage", "valid_until"],
        [
            ["1", "Desconto 20%", "20% off em hambúrgueres", "20", "2024-12-31"],
            ["2", "Combo Família", "2 Big Mac + batatas", "15", "2024-12-25"],
            ["3", "Pizza em Dobro", "Compre 1 leve 2", "50", "2024-12-30"],
        ],
    ),
    "produtos": (
        ["nome", "descricao", "preco", "categoria", "disponivel"],
        [
            ["iPhone 15", "Smartphone Apple", "4999.99", "Eletrônicos", "true"],
            ["Samsung Galaxy", "Smartphone Samsung", "3499.99", "Eletrônicos", "true"],
            ["Notebook Dell", "Laptop para trabalho", "2999.99", "Informática", "true"],
        ],
    ),
    "usuarios": (
        ["nome", "email", "telefone", "cidade", "ativo"],
        [
            ["João Silva", "joao@email.com", "(11)99999-9999", "São Paulo", "true"],
            ["Maria Santos", "maria@email.com", "(21)88888-8888", "Rio de Janeiro", "true"],
            ["Pedro Costa", "pedro@email.com", "(11)77777-7777", "São Paulo", "true"],
        ],
    ),
}


def insert_samples(df: DataFrame, name: str, schema: T.StructType) -> DataFrame:
    """The table with the example rows of ``name`` added."""
    columns, examples = SAMPLES[name]
    listed = [[str(position), *row] for position, row in enumerate(examples)]
    typed_in = df.sparkSession.createDataFrame(listed, ["_position", *columns])
    return insert(df, typed_in, schema, "_position")[0]


# --- update -----------------------------------------------------------------


def _new_values(df: DataFrame, values: Mapping[str, object], condition: Column | None, key: str) -> DataFrame:
    if key in values:
        raise ValueError(f"{key} is never changed")
    updates = {}
    for name, value in values.items():
        new = typed(df, name, value)
        updates[name] = new if condition is None else F.when(condition, new).otherwise(F.col(name))
    return df.withColumns(updates)


def _matches(df: DataFrame, column: str, value) -> Column:
    return F.col(column) == typed(df, column, value)


def update_by_id(df: DataFrame, row_id, values: Mapping[str, object], key: str = "id") -> DataFrame:
    return _new_values(df, values, _matches(df, key, row_id), key)


def affected(df: DataFrame, column: str, value) -> DataFrame:
    """How many rows a change by ``column = value`` touches."""
    return df.where(_matches(df, column, value)).agg(F.count(F.lit(1)).alias("affected"))


def update_where(
    df: DataFrame, column: str, value, values: Mapping[str, object], key: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """(changed table, number of rows changed)."""
    return _new_values(df, values, _matches(df, column, value), key), affected(df, column, value)


def update_all(df: DataFrame, values: Mapping[str, object], key: str = "id") -> DataFrame:
    return _new_values(df, values, None, key)


def patch(df: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Replace values by the updates' non-null ones; of several for one key and column the largest counts."""
    names = [name for name in updates.columns if name != key]
    renamed = updates.groupBy(key).agg(*[F.max(name).alias(f"_new_{name}") for name in names])
    changed = {name: F.coalesce(F.col(f"_new_{name}").cast(df.schema[name].dataType), F.col(name)) for name in names}
    return df.join(renamed, key, "left").withColumns(changed).select(df.columns)


def affected_by_patch(df: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """How many rows a patch touches: those whose key has an update."""
    return df.select(key).join(updates.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("affected"))


# --- delete -----------------------------------------------------------------


def _without(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column differs from the value or is NULL, in a form the scan can use."""
    if value is None:
        # Nothing equals NULL.
        return df
    return df.where((F.col(column) != typed(df, column, value)) | F.col(column).isNull())


def delete_by_id(df: DataFrame, row_id, key: str = "id") -> DataFrame:
    return _without(df, key, row_id)


def delete_where(df: DataFrame, column: str, value) -> tuple[DataFrame, DataFrame]:
    """(remaining table, number of rows deleted)."""
    return _without(df, column, value), affected(df, column, value)


def delete_all(df: DataFrame) -> DataFrame:
    """No rows, same schema."""
    return df.limit(0)


# Which tables refer to which, and the column names that mean a reference.
KNOWN_REFERENCES = {
    "restaurants": [("products", "restaurant_id"), ("dishes", "restaurant_id"), ("promotions", "restaurant_id")],
    "categories": [],
}
REFERENCE_NAMES = {"restaurants": "restaurant_id", "categories": "category_id"}


def references(tables: Mapping[str, DataFrame], parent: str) -> list[tuple[str, str]]:
    """(table, column) pairs that refer to ``parent``: known ones, then those found by column name."""
    pairs = [(table, column) for table, column in KNOWN_REFERENCES.get(parent, []) if table in tables]
    mapped = {table for table, _ in pairs}
    word = REFERENCE_NAMES.get(parent)
    for table, frame in tables.items():
        if word is None or table == parent or table in mapped:
            continue
        found = [column for column in frame.columns if word in column]
        if found:
            pairs.append((table, found[0]))
    return pairs


def dependencies(tables: Mapping[str, DataFrame], parent: str, key: str = "id") -> DataFrame:
    """Tables with rows that refer to rows of ``parent``, and how many."""
    parts = [
        reference_count(tables[table], column, tables[parent], key).select(
            F.lit(table).alias("table"), F.lit(column).alias("column"), F.col("references").alias("count")
        )
        for table, column in references(tables, parent)
    ]
    if not parts:
        spark = tables[parent].sparkSession
        return spark.createDataFrame([], "`table` string, `column` string, `count` bigint")
    return reduce(DataFrame.unionByName, parts).where("count > 0")


def delete_cascade(
    tables: Mapping[str, DataFrame], parent: str, keys: DataFrame | None = None, key: str = "id"
) -> dict[str, DataFrame]:
    """The tables without the parent rows in ``keys`` (default: all) and the rows that refer to them."""
    doomed = materialise((tables[parent] if keys is None else keys).select(key).distinct())
    left = dict(tables)
    for table, column in [*references(tables, parent), (parent, key)]:
        # Rows that name no parent match nothing and stay.
        left[table] = lookup_join(tables[table], doomed, column, key, "left_anti", written=True)
    return left


def _rows_with_keys(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """How many rows have one of ``keys``; rows are counted per key before they meet the keys."""
    per_key = df.groupBy(F.col(column).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    found = per_key.join(keys.select(F.col(key).alias("_key")), "_key", "left_semi")
    return found.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("affected"))


def affected_by_cascade(
    tables: Mapping[str, DataFrame], parent: str, keys: DataFrame | None = None, key: str = "id"
) -> DataFrame:
    """How many rows ``delete_cascade`` removes from each table it looks at."""
    doomed = materialise((tables[parent] if keys is None else keys).select(key).distinct())
    parts = [
        _rows_with_keys(tables[table], column, doomed, key).select(F.lit(table).alias("table"), "affected")
        for table, column in [*references(tables, parent), (parent, key)]
    ]
    return reduce(DataFrame.unionByName, parts)


# --- retention --------------------------------------------------------------

# Columns a row's age is read from, in order of preference.
AGE_COLUMNS = ("scraped_at", "created_at", "updated_at")


def retain(df: DataFrame, as_of: str, days: int = 30, columns: Sequence[str] = AGE_COLUMNS) -> DataFrame:
    """Rows not older than ``days`` by the first age column the table has; undated rows stay."""
    usable = [name for name in columns if name in df.columns]
    if not usable:
        return df
    age = F.col(usable[0])
    return df.where((age >= days_before(df, usable[0], as_of, days)) | age.isNull())


def affected_by_retention(df: DataFrame, as_of: str, days: int = 30, columns: Sequence[str] = AGE_COLUMNS) -> DataFrame:
    """How many rows ``retain`` removes."""
    usable = [name for name in columns if name in df.columns]
    old = F.col(usable[0]) < days_before(df, usable[0], as_of, days) if usable else F.lit(False)
    return df.where(old).agg(F.count(F.lit(1)).alias("affected"))


def affected_by_orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """How many rows ``drop_orphans`` removes."""
    return _rows_with_keys(child, column, orphan_keys(child, column, parent, key), column)


def drop_orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose parent exists, and rows that name none."""
    return lookup_join(child, orphan_keys(child, column, parent, key), column, how="left_anti")
