"""Table definitions: canonical tables, templates, and a builder for new ones."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The column types a table definition may use. BIGINT is ours, for
# keys and references to them, which outgrow 32 bits in a large table.
TYPES: dict[str, T.DataType] = {
    "BIGINT": T.LongType(),
    "INTEGER": T.IntegerType(),
    "VARCHAR": T.StringType(),
    "DECIMAL": T.DecimalType(10, 2),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
    "TEXT": T.StringType(),
}


def table_def(columns: Iterable[tuple]) -> T.StructType:
    """Schema from ``(name, type, nullable, key)`` rows.

    Key columns are never nullable; the key flag is kept in the field's metadata.
    A fifth value, if given, is the column's default as text.
    """
    fields = []
    for name, type_name, nullable, key, *default in columns:
        base = type_name.upper().split("(")[0]
        if base not in TYPES:
            raise ValueError(f"unknown type {type_name!r} of column {name!r}; use one of {sorted(TYPES)}")
        data_type = TYPES[base]
        if base == "DECIMAL" and "(" in type_name:
            precision, scale = type_name.split("(")[1].rstrip(")").split(",")
            data_type = T.DecimalType(int(precision), int(scale))
        metadata: dict = {"key": True} if key else {}
        if default:
            metadata["default"] = default[0]
        fields.append(T.StructField(name, data_type, nullable and not key, metadata))
    names = [field.name.lower() for field in fields]
    if len(set(names)) != len(names):
        raise ValueError("a column name occurs twice")
    return T.StructType(fields)


RESTAURANTS = table_def(
    [
        ("id", "BIGINT", False, True),
        ("name", "VARCHAR", False, False),
        ("category", "VARCHAR", False, False),
        ("rating", "DECIMAL(2,1)", True, False),
        ("delivery_time", "INTEGER", True, False),
        ("delivery_fee", "DECIMAL", True, False),
        ("city", "VARCHAR", False, False),
        ("link", "VARCHAR", True, False),
        ("reviews", "INTEGER", True, False),
        ("min_order", "DECIMAL", True, False),
        ("scraped_at", "TIMESTAMP", True, False, "current_timestamp"),
    ]
)

PRODUCTS = table_def(
    [
        ("id", "BIGINT", False, True),
        ("restaurant_id", "BIGINT", True, False),
        ("restaurant_name", "VARCHAR", True, False),
        ("category", "VARCHAR", True, False),
        ("name", "VARCHAR", False, False),
        ("description", "TEXT", True, False),
        ("price", "DECIMAL", True, False),
        ("scraped_at", "TIMESTAMP", True, False, "current_timestamp"),
    ]
)

CATEGORIES = table_def(
    [
        ("id", "BIGINT", False, True),
        ("categorias", "VARCHAR", False, False),
        ("links", "VARCHAR", False, False),
        ("created_at", "TIMESTAMP", True, False, "current_timestamp"),
    ]
)

DISHES = table_def(
    [
        ("id", "BIGINT", False, True),
        ("restaurant_id", "BIGINT", True, False),
        ("name", "VARCHAR", False, False),
        ("description", "TEXT", True, False),
        ("price", "DECIMAL", True, False),
        ("category", "VARCHAR", True, False),
        ("available", "BOOLEAN", True, False, "true"),
    ]
)

PROMOTIONS = table_def(
    [
        ("id", "BIGINT", False, True),
        ("restaurant_id", "BIGINT", True, False),
        ("title", "VARCHAR", True, False),
        ("description", "TEXT", True, False),
        ("discount_percentage", "INTEGER", True, False),
        ("valid_until", "DATE", True, False),
    ]
)

SCRAPING_LOGS = table_def(
    [
        ("id", "BIGINT", False, True),
        ("timestamp", "TIMESTAMP", True, False, "current_timestamp"),
        ("city", "VARCHAR", True, False),
        ("status", "VARCHAR", True, False),
        ("restaurants_found", "INTEGER", True, False),
        ("dishes_found", "INTEGER", True, False),
        ("errors", "INTEGER", True, False),
        ("duration_seconds", "INTEGER", True, False),
    ]
)

SCHEMA_VERSIONS = table_def(
    [
        ("id", "BIGINT", False, True),
        ("version", "VARCHAR", False, False),
        ("description", "VARCHAR", True, False),
        ("applied_at", "TIMESTAMP", True, False, "current_timestamp"),
        ("checksum", "VARCHAR", True, False),
    ]
)

# Entries of the query log. Its id gives the order of entries with equal times.
QUERY_LOG = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("query", T.StringType()),
        T.StructField("execution_time", T.DoubleType()),
        T.StructField("result_count", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

# The four templates a table can be created from.
TEMPLATES: dict[str, T.StructType] = {
    "produtos": table_def(
        [
            ("id", "BIGINT", False, True),
            ("nome", "VARCHAR(255)", False, False),
            ("descricao", "TEXT", True, False),
            ("preco", "DECIMAL(10,2)", False, False),
            ("categoria", "VARCHAR(100)", True, False),
            ("disponivel", "BOOLEAN", True, False, "true"),
            ("criado_em", "TIMESTAMP", True, False, "current_timestamp"),
        ]
    ),
    "usuarios": table_def(
        [
            ("id", "BIGINT", False, True),
            ("nome", "VARCHAR(255)", False, False),
            ("email", "VARCHAR(255)", False, False),
            ("telefone", "VARCHAR(20)", True, False),
            ("cidade", "VARCHAR(100)", True, False),
            ("ativo", "BOOLEAN", True, False, "true"),
            ("criado_em", "TIMESTAMP", True, False, "current_timestamp"),
        ]
    ),
    "pedidos": table_def(
        [
            ("id", "BIGINT", False, True),
            ("usuario_id", "BIGINT", True, False),
            ("total", "DECIMAL(10,2)", False, False),
            ("status", "VARCHAR(50)", True, False, "pendente"),
            ("endereco_entrega", "TEXT", True, False),
            ("data_pedido", "TIMESTAMP", True, False, "current_timestamp"),
        ]
    ),
    "logs_sistema": table_def(
        [
            ("id", "BIGINT", False, True),
            ("nivel", "VARCHAR(20)", False, False),
            ("mensagem", "TEXT", False, False),
            ("modulo", "VARCHAR(100)", True, False),
            ("timestamp", "TIMESTAMP", True, False, "current_timestamp"),
        ]
    ),
}


def base_schemas() -> dict[str, T.StructType]:
    """The canonical tables by name."""
    return {
        "categories": CATEGORIES,
        "restaurants": RESTAURANTS,
        "products": PRODUCTS,
        "dishes": DISHES,
        "promotions": PROMOTIONS,
        "scraping_logs": SCRAPING_LOGS,
    }


def template(name: str, rename: str | None = None) -> tuple[str, T.StructType]:
    """A template's table name (or the name wanted instead) and its schema."""
    if name not in TEMPLATES:
        raise KeyError(f"no template {name!r}; there are {sorted(TEMPLATES)}")
    return rename or name, TEMPLATES[name]


def conform(df: DataFrame, schema: T.StructType, as_of: str | None = None) -> DataFrame:
    """Columns of ``schema`` in its order and types; absent ones take their default or NULL.

    ``as_of`` is the value of ``current_timestamp`` defaults, so a rerun gives the same rows.
    """
    columns = []
    for field in schema.fields:
        if field.name in df.columns:
            value = F.col(field.name)
        else:
            default = field.metadata.get("default")
            value = F.lit(as_of if default == "current_timestamp" else default)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(columns)


def is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType)


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)
