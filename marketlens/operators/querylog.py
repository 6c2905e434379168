"""Analytics over the query log (id, ts, query, execution_time, result_count, status, error)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.checks import latency_grade
from marketlens.functions.literals import typed
from marketlens.functions.numeric import exact_mean, percent


def _newest() -> list[Column]:
    return [F.desc_nulls_last("ts"), F.desc("id")]


def _oldest() -> list[Column]:
    return [F.asc_nulls_first("ts"), F.asc("id")]


def recent_queries(log: DataFrame, n: int = 20) -> DataFrame:
    return log.orderBy(*_newest()).limit(n)


def recent_errors(log: DataFrame, n: int = 10) -> DataFrame:
    """The last errors, oldest of them first."""
    return log.where(F.col("status") == "error").orderBy(*_newest()).limit(n).orderBy(*_oldest())


def slowest(log: DataFrame, n: int = 10) -> DataFrame:
    return log.orderBy(F.desc_nulls_last("execution_time"), "id").limit(n)


def log_stats(log: DataFrame) -> DataFrame:
    """Entries, successes, errors (with percentages) and execution times, in microseconds for an exact mean."""
    total = F.count(F.lit(1))
    good = F.count_if(F.col("status") == "success")
    # Decimal, because a bigint sum of microseconds can overflow.
    micros = F.round(F.col("execution_time") * 1_000_000).cast("decimal(20,0)")
    return log.agg(
        total.alias("total"),
        good.alias("successful"),
        (total - good).alias("errors"),
        percent(good, total).alias("success_pct"),
        percent(total - good, total).alias("error_pct"),
        (exact_mean(micros) / 1_000_000.0).alias("avg_time"),
        F.min("execution_time").alias("min_time"),
        F.max("execution_time").alias("max_time"),
    )


def queries_on(log: DataFrame, as_of: str) -> DataFrame:
    """Entries of one day, as a range of times so that files can be skipped."""
    day = F.to_date(F.lit(as_of))
    start, end = typed(log, "ts", day), typed(log, "ts", F.date_add(day, 1))
    return log.where((F.col("ts") >= start) & (F.col("ts") < end))


def search_log(log: DataFrame, term: str, n: int = 10) -> DataFrame:
    """The last entries whose query contains the term in any case, oldest of them first."""
    found = log.where(F.lower("query").contains(term.lower()))
    return found.orderBy(*_newest()).limit(n).orderBy(*_oldest())


def retain_log(log: DataFrame, n: int = 100) -> DataFrame:
    """The newest entries; 0 clears the log."""
    return log.orderBy(*_newest()).limit(n)


def latency_grades(log: DataFrame) -> DataFrame:
    return log.groupBy(latency_grade(F.col("execution_time")).alias("grade")).agg(F.count(F.lit(1)).alias("queries"))
