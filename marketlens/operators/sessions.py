"""Sessions: rows of a key that follow each other within a gap; one definition for tables and streams.

A key's time is cut into spans. Sessions are found within each span, by a window that holds one span of one key; those that may go on
in a neighbouring span are merged afterwards. They are at most two per span, so a key with very many rows is no long sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN_SECONDS = 6 * 3600


def _totals(measures: Mapping[str, Column]) -> dict[str, Column]:
    """What a session sums up: its rows, and a whole number per row for each measure."""
    return {"entries": F.lit(1).cast("long"), **{name: value.cast("long") for name, value in measures.items()}}


def sessions(
    df: DataFrame, keys: Sequence[str], time: str, gap: int, measures: Mapping[str, Column] | None = None, span: int = SPAN_SECONDS
) -> DataFrame:
    """keys, start, end (of the first and the last row), entries and the sums of ``measures`` of every session.

    A row belongs to the session before it if less than ``gap`` seconds have passed. Rows without a time are in none;
    null keys are keys like others.
    """
    if span < gap:
        raise ValueError("a span must not be shorter than the gap")
    totals, micros = _totals(measures or {}), 1_000_000
    rows = df.where(F.col(time).isNotNull()).select(*keys, F.unix_micros(F.col(time).cast("timestamp")).alias("_at"), *[v.alias(n) for n, v in totals.items()])
    rows = rows.withColumn("_span", F.floor(F.col("_at") / (span * micros)))
    inside = Window.partitionBy(*keys, "_span").orderBy("_at")
    before = F.lag("_at").over(inside)
    begins = F.when(before.isNull() | (F.col("_at") - before >= gap * micros), 1).otherwise(0)
    numbered = rows.withColumn("_begins", begins).withColumn("_number", F.sum("_begins").over(inside))

    def merged(parts: DataFrame, by: list[str], low: str, high: str) -> DataFrame:
        sums = [F.sum(name).alias(name) for name in totals]
        return parts.groupBy(*keys, *by).agg(F.min(low).alias("_start"), F.max(high).alias("_end"), *sums)

    # Partitioned as the window is: nothing moves.
    partial = merged(numbered, ["_span", "_number"], "_at", "_at")
    left = F.col("_start") - F.col("_span") * (span * micros) < gap * micros
    right = (F.col("_span") + 1) * (span * micros) - F.col("_end") <= gap * micros
    parts = partial.withColumn("_open", left | right)
    # Only the first session of a span can be open to the left, only the last to the right.
    chain = Window.partitionBy(*keys).orderBy("_start")
    last = F.lag("_end").over(chain)
    again = F.when(last.isNull() | (F.col("_start") - last >= gap * micros), 1).otherwise(0)
    opened = parts.where("_open").withColumn("_again", again).withColumn("_chain", F.sum("_again").over(chain))
    columns = [*keys, "_start", "_end", *totals]
    whole = parts.where("NOT _open").select(columns).unionByName(merged(opened, ["_chain"], "_start", "_end").select(columns))
    kind = df.schema[time].dataType
    times = [F.timestamp_micros(f"_{name}").cast(kind).alias(name) for name in ("start", "end")]
    return whole.select(*keys, *times, *totals)


def stream_sessions(
    stream: DataFrame, keys: Sequence[str], time: str, gap: int, delay: str, measures: Mapping[str, Column] | None = None
) -> DataFrame:
    """The same sessions of a stream, as mergeable state: complete ones are final when the watermark has passed their gap."""
    totals = _totals(measures or {})
    made = stream.select(*keys, time, *[value.alias(name) for name, value in totals.items()]).withWatermark(time, delay)
    # The engine also joins rows that are exactly its gap apart.
    grouped = made.groupBy(F.session_window(time, f"{gap * 1_000_000 - 1} microseconds").alias("_session"), *keys)
    found = grouped.agg(F.min(time).alias("start"), F.max(time).alias("end"), *[F.sum(name).alias(name) for name in totals])
    return found.select(*keys, "start", "end", *totals)
