"""Integrity rules, duplicates and the quality report.

All rules that look at one row at a time are counted in one pass per table;
duplicates are counted by group keys with partial counts in the map tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.checks import is_missing, quality_band, quality_score
from marketlens.functions.literals import typed
from marketlens.functions.numeric import exact_mean, percent, round_half_up
from marketlens.schemas import base_schemas, is_text


# --- duplicates -------------------------------------------------------------


def duplicate_groups(df: DataFrame, ignore: Sequence[str] = ("id",)) -> DataFrame:
    """Groups of rows equal on all columns but the ignored ones, with their size."""
    columns = [name for name in df.columns if name not in ignore]
    return df.groupBy(columns).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def duplicate_summary(df: DataFrame, ignore: Sequence[str] = ("id",)) -> DataFrame:
    """Number of duplicate groups and of rows a clean-up would remove."""
    return duplicate_groups(df, ignore).agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("removable")
    )


def drop_exact_duplicates(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per group of equal rows, the one with the smallest key.

    All other columns are group keys, so the smallest key is all there is to
    aggregate: copies merge in the map tasks and no window is needed.
    """
    columns = [name for name in df.columns if name != key]
    return df.groupBy(columns).agg(F.min(key).alias(key)).select(df.columns)


def duplicate_names(df: DataFrame, column: str) -> DataFrame:
    """How many names occur more than once, compared as they are."""
    groups = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("duplicates"))


def normalised(column: str) -> Column:
    return F.lower(F.trim(F.col(column)))


def duplicate_names_normalised(df: DataFrame, column: str) -> DataFrame:
    """How many names occur more than once, ignoring case and outer blanks."""
    groups = df.groupBy(normalised(column).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("duplicates"))


# --- rows breaking a rule ---------------------------------------------------


def required_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values of each required column."""
    counts = df.agg(*[F.count_if(is_missing(F.col(c), is_text(df.schema[c]))).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "n")


def bad_url(column: str) -> Column:
    return ~F.col(column).startswith("http") & (F.col(column) != "")


def too_short(column: str, min_len: int) -> Column:
    return F.length(F.trim(F.col(column))) < min_len


def outside(column: str, low, high) -> Column:
    return (F.col(column) < low) | (F.col(column) > high)


def after(df: DataFrame, column: str, as_of: str) -> Column:
    return F.col(column) > typed(df, column, as_of)


def bad_urls(df: DataFrame, column: str) -> DataFrame:
    return df.where(bad_url(column))


def short_names(df: DataFrame, column: str, min_len: int = 2) -> DataFrame:
    return df.where(too_short(column, min_len))


def out_of_range(df: DataFrame, column: str, low=0, high=5) -> DataFrame:
    return df.where(outside(column, low, high))


def negatives(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) < 0)


def future_rows(df: DataFrame, column: str, as_of: str) -> DataFrame:
    return df.where(after(df, column, as_of))


def orphan_rule(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Number of child rows without a parent row.

    Children are counted per key before the join, so a frequent key is one row in it.
    """
    per_key = (
        child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    )
    parents = parent.select(F.col(key).alias("_key"))
    return per_key.join(parents, "_key", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))


# --- validation -------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A named condition that bad rows of one table meet."""

    table: str
    name: str
    condition: Callable[[DataFrame], Column]


def missing_rule(table: str, column: str) -> Rule:
    return Rule(table, f"missing_{column}", lambda df: is_missing(F.col(column), is_text(df.schema[column])))


def schema_rules(table: str, schema: T.StructType, as_of: str) -> list[Rule]:
    """What a schema asks of any table: values in columns that are not nullable, no creation time to come."""
    rules = [missing_rule(table, field.name) for field in schema.fields if not field.nullable]
    if "created_at" in schema.fieldNames():
        rules.append(Rule(table, "future_created_at", lambda df: after(df, "created_at", as_of)))
    return rules


def default_rules(as_of: str, schemas: Mapping[str, T.StructType] | None = None) -> list[Rule]:
    """The rules of ``schemas`` (default: the canonical tables), links, short names and the rating range."""
    chosen = base_schemas() if schemas is None else schemas
    rules = [rule for table, schema in chosen.items() for rule in schema_rules(table, schema, as_of)]
    return rules + [
        Rule("categories", "bad_url", lambda df: bad_url("links")),
        Rule("categories", "short_name", lambda df: too_short("categorias", 2)),
        Rule("restaurants", "rating_out_of_range", lambda df: outside("rating", 0, 5)),
    ]


# The column a table's rows are named by.
NAME_COLUMNS = {"categories": "categorias", "restaurants": "name", "products": "name"}


def validate(
    tables: Mapping[str, DataFrame],
    rules: Sequence[Rule],
    name_columns: Mapping[str, str] = NAME_COLUMNS,
) -> DataFrame:
    """Rows breaking each rule: (table, rule, n, counted).

    Repeated names are reported too but are a hint, not an issue (``counted`` false).
    """
    parts = []
    for name, frame in tables.items():
        own = [rule for rule in rules if rule.table == name]
        if own:
            counts = frame.agg(*[F.count_if(rule.condition(frame)).alias(rule.name) for rule in own])
            long = counts.unpivot([], [rule.name for rule in own], "rule", "n")
            parts.append(long.select(F.lit(name).alias("table"), "rule", "n", F.lit(True).alias("counted")))
        if name in name_columns:
            repeated = duplicate_names(frame, name_columns[name])
            parts.append(
                repeated.select(
                    F.lit(name).alias("table"),
                    F.lit("repeated_name").alias("rule"),
                    F.col("duplicates").alias("n"),
                    F.lit(False).alias("counted"),
                )
            )
    return reduce(DataFrame.unionByName, parts)


def validation_totals(validated: DataFrame) -> DataFrame:
    """Issues per table and, with table NULL, over all tables."""
    return validated.where("counted").rollup("table").agg(F.sum("n").alias("issues"))


# --- quality report ---------------------------------------------------------


def null_counts(df: DataFrame, key: str = "id") -> DataFrame:
    """Missing values of every column but the key, from one pass: (column, nulls, rows)."""
    fields = [field for field in df.schema.fields if field.name != key]
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(is_missing(F.col(f.name), is_text(f))).alias(f.name) for f in fields],
    )
    return counts.unpivot(["_rows"], [f.name for f in fields], "column", "nulls").withColumnRenamed("_rows", "rows")


def null_issues(df: DataFrame, threshold: float = 10.0, key: str = "id") -> DataFrame:
    """Columns with more than ``threshold`` percent of their values missing."""
    share = percent(F.col("nulls"), F.col("rows"))
    return null_counts(df, key).select("column", "nulls", share.alias("pct")).where(F.col("pct") > threshold)


def report_rules() -> list[tuple[Rule, str]]:
    """The report's own checks and the text that follows their count (fixed values)."""
    return [
        (
            Rule("restaurants", "rating_out_of_range", lambda df: outside("rating", 0, 5)),
            "ratings inválidos (fora de 0-5)",
        ),
        (Rule("restaurants", "negative_fee", lambda df: F.col("delivery_fee") < 0), "taxas de entrega negativas"),
        (Rule("products", "negative_price", lambda df: F.col("price") < 0), "preços negativos"),
    ]


def _table_report(name: str, df: DataFrame, rules: Sequence[tuple[Rule, str]], name_column: str | None) -> DataFrame:
    fields = [field for field in df.schema.fields if field.name != "id"]
    own = [(rule, text) for rule, text in rules if rule.table == name]
    counts = df.agg(
        F.count(F.lit(1)).alias("record_count"),
        *[F.count_if(is_missing(F.col(f.name), is_text(f))).alias(f"null_{f.name}") for f in fields],
        *[F.count_if(rule.condition(df)).alias(f"rule_{rule.name}") for rule, _ in own],
    )
    duplicates = F.lit(0).cast("bigint")
    if name_column is not None:
        # A scalar subquery, because the group keys need a shuffle of their own.
        duplicates = duplicate_names_normalised(df, name_column).scalar()
    counts = counts.withColumn("duplicate_records", duplicates)

    rows = F.col("record_count")
    texts = []
    for field in fields:
        share = percent(F.col(f"null_{field.name}"), rows)
        shown = F.format_string("%.1f", round_half_up(share, 1))
        text = F.concat(F.lit(f"Campo '{field.name}': "), shown, F.lit("% valores nulos"))
        texts.append(F.when(share > 10.0, text))
    found = [(F.col("duplicate_records"), "possíveis duplicatas detectadas")]
    found += [(F.col(f"rule_{rule.name}"), text) for rule, text in own]
    texts += [F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {text}"))) for n, text in found]

    nulls = reduce(lambda a, b: a + b, [F.col(f"null_{f.name}") for f in fields])
    issues = F.array_compact(F.array(*texts))
    score = quality_score(rows, F.lit(len(df.columns)), F.col("null_fields"), F.size("issues"))
    return (
        counts.select(F.lit(name).alias("table"), "record_count", nulls.alias("null_fields"), "duplicate_records", issues.alias("issues"))
        .withColumn("data_quality_score", score)
        .withColumn("band", quality_band(F.col("data_quality_score")))
    )


def quality_report(
    tables: Mapping[str, DataFrame],
    rules: Sequence[tuple[Rule, str]] | None = None,
    name_columns: Mapping[str, str] = NAME_COLUMNS,
) -> tuple[DataFrame, DataFrame]:
    """(one row per table with its score and issues, one summary row)."""
    chosen = report_rules() if rules is None else rules
    per_table = reduce(
        DataFrame.unionByName,
        [_table_report(name, df, chosen, name_columns.get(name)) for name, df in tables.items()],
    )
    return per_table, report_summary(per_table)


def report_summary(per_table: DataFrame) -> DataFrame:
    """Totals and the mean score over a report's tables."""
    # Scores have one decimal: summed as decimals, the mean does not depend on their order.
    score = F.col("data_quality_score").cast("decimal(5,1)")
    summary = per_table.agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.sum("record_count").alias("total_records"),
        F.sum("null_fields").alias("total_nulls"),
        F.sum("duplicate_records").alias("total_duplicates"),
        round_half_up(exact_mean(score), 1).alias("average_quality_score"),
    )
    return summary.withColumn("band", quality_band(F.col("average_quality_score")))
