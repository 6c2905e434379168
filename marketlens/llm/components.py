"""Connected components by alternating stars, one written table per half round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.sources.scratch import materialise


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest node they share: the larger ones (large star) or the smaller ones.

    The minimum is taken by a combining aggregate and both sides of the join are tables, so
    that a node with very many neighbours is split over tasks.
    """
    if large:
        pairs = pairs.unionByName(pairs.select(F.col("parent").alias("node"), F.col("node").alias("parent")))
    least = materialise(pairs.groupBy("node").agg(F.min("parent").alias("_low")))
    joined = pairs.join(least, "node")
    if large:
        low = F.least("node", "_low")
        links = joined.where("parent > node").select(F.col("parent").alias("node"), low.alias("parent"))
    else:
        links = joined.select(
            F.explode(F.array(F.struct("node", F.col("_low").alias("parent")), F.struct(F.col("parent").alias("node"), F.col("_low").alias("parent")))).alias("_link")
        ).select("_link.*")
    return materialise(links.where("node != parent").distinct())


def _mark(pairs: DataFrame) -> tuple:
    """Row count and an order-free digest of a table of pairs."""
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "parent"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of ``links`` (node, parent; node > parent) but the roots, the smallest node it reaches.

    The number of rounds grows with the logarithm of the longest path. Rows are ids; none are collected.
    """
    pairs = materialise(links.select("node", "parent").distinct())
    before = _mark(pairs)
    while before[0]:
        pairs = _star(_star(pairs, large=True), large=False)
        after = _mark(pairs)
        if after == before:
            break
        before = after
    return pairs.withColumnRenamed("parent", "root")
