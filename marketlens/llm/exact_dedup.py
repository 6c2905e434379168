"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition is a run: one row per digest with the best identifier and the
row count. Runs then merge in rounds of a hypercube: in round r the runs that agree in
all radix-16 digits but the r-th exchange rows, and each keeps the digests whose own r-th digit is
its new number. A round sorts what up to 16 runs have sent by (run, digest, check, identifier) and passes along that order: the
first row of a digest stays with the others' rows added. After the last round a digest lives
in a single run. Rows of one digest are reduced to one per run before they move, so a
digest that a third of all rows share costs one row per run and round.

A digest stands for a text, which is verified twice: a second hash and the length are compared at every level, and the whole
texts of a digest are compared byte for byte once, whatever level they meet on.

The way back is short: the merged digests meet the first runs (one row per run and
digest), and those meet the documents by run and digest, which keeps a large group spread
over as many tasks as it had partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import keep_rows, lower_ascii, whole_text
from marketlens.sources.scratch import materialise

RADIX_BITS = 4
ROUNDS = 3
RUNS = 1 << (RADIX_BITS * ROUNDS)


def normal_text() -> Column:
    """What is compared: the whole text (null: empty), A-Z in lower case."""
    return lower_ascii(whole_text())


def text_digests(text: Column) -> tuple[Column, Column]:
    """The digest of a text, and what verifies it at every level: an independent hash that covers the length too."""
    return F.unhex(F.sha2(text, 256)), F.xxhash64(text, F.octet_length(text))


def merge_runs(level: DataFrame, keep: str = "max") -> DataFrame:
    """All rounds over (run, digest, check, best, rows); one row per digest is left."""
    target = F.conv(F.substring(F.hex("digest"), 1, ROUNDS * RADIX_BITS // 4), 16, 10).cast("int")
    wins = {"max": F.desc_nulls_last, "min": F.asc_nulls_last}[keep]
    same = Window.partitionBy("run", "digest", "check")
    for step in range(ROUNDS):
        digit = ((1 << RADIX_BITS) - 1) << (RADIX_BITS * step)
        partner = F.col("run").bitwiseAND((RUNS - 1) & ~digit).bitwiseOR(target.bitwiseAND(digit))
        # Rows go by run alone, so a task holds whole runs and one sort serves the window; a digest has at most 16 rows in it.
        sent = level.withColumn("run", partner).repartition("run")
        order = same.orderBy(wins("best"))
        merged = sent.withColumn("place", F.row_number().over(order)).withColumn(
            "rows", F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        )
        level = merged.where("place = 1").drop("place")
    return level.drop("run")


def verify_texts(docs: DataFrame, digests: Callable[[Column], tuple[Column, Column]] = text_digests) -> None:
    """Raise if two texts of ``docs`` that share digest and check are not the same, byte for byte.

    Different texts are counted per digest. Map tasks drop the repeats of a text first, so a frequent one moves once per task.
    """
    digest, check = digests(F.col("text"))
    texts = docs.select(normal_text().alias("text")).select("text", digest.alias("digest"), check.alias("check")).distinct()
    if not texts.groupBy("digest", "check").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").isEmpty():
        raise ValueError("different texts have the same digest")


def exact_groups(
    docs: DataFrame, keep: str = "max", digests: Callable[[Column], tuple[Column, Column]] = text_digests
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, digest, check.

    Texts are equal when identical after lower-casing A-Z. ``keep`` says whether the
    largest or the smallest doc_id of a group stays. A digest is SHA-256; a second, independent
    hash and the length are part of every comparison. Where rows share all of these, their texts are compared, and
    the call raises if two differ: it never merges two texts.

    Null texts count as empty. A null doc_id never wins against another one; a group with none but
    null ids keeps null. Repeated rows count in group_size each. An empty table gives an
    empty result. Other columns are not read.
    """
    best = {"max": F.max, "min": F.min}[keep]
    digest, check = digests(F.col("_text"))
    rows = materialise(
        docs.select("doc_id", normal_text().alias("_text")).select(
            "doc_id",
            digest.alias("digest"),
            check.alias("check"),
            F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run"),
        )
    )
    runs = rows.groupBy("run", "digest", "check").agg(
        best("doc_id").alias("best"), F.count(F.lit(1)).alias("rows")
    )
    verify_texts(docs, digests)
    merged = merge_runs(runs, keep).select(
        "digest", "check", F.col("best").alias("keep_id"), F.col("rows").alias("group_size")
    )
    told = runs.select("run", "digest", "check").join(merged, ["digest", "check"])
    return rows.join(told, ["run", "digest", "check"]).drop("run")


def drop_exact_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """``docs`` with one row per text, all columns unchanged.

    Of rows that share text and doc_id, the one with the smallest other columns stays.
    """
    groups = exact_groups(docs, keep)
    kept = (
        groups.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("doc_id", F.col("digest").alias("_key"), "check")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    return keep_rows(docs, text_digests(normal_text())[0], kept)
