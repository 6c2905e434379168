"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2h bits share a variant within h bits of both. Every distinct
fingerprint emits all variants within h, and the variants are shuffled. All members of one variant's bucket lie within
2h bits of each other, and there are no more of them than variants of one fingerprint; so
each member is linked to the bucket's smallest, which keeps the connections and needs no pairs.
Links are deduplicated and verified, then joined to components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from marketlens.llm.common import bounded_batches, keep_rows, whole_text
from marketlens.llm.components import components
from marketlens.sources.scratch import materialise

WORDS = 3
RADIUS = 2
SEED = 42
_CHUNK = 1 << 16


def simhash(text: str, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a whole text as a signed number.

    Words are separated by ASCII white space, A-Z in lower case; repeated shingles count each time. Fewer words
    than a shingle has: all of them are one. No words: zero.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles, n = iter([b" ".join(found)]), 1
    else:
        shingles, n = map(b" ".join, zip(*[found[i:] for i in range(words)])), len(found) - words + 1
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for begin in range(0, n, _CHUNK):
        size = min(_CHUNK, n - begin)
        hashes = np.fromiter((digest(s, SEED) for _, s in zip(range(size), shingles)), dtype="<u8", count=size)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """Fingerprints of whole texts."""
    return pd.Series([simhash(text) for text in texts], dtype="int64", index=texts.index)


def _variants(value: Column, half: int) -> Column:
    masks = [sum(1 << bit for bit in bits) for n in range(half + 1) for bits in combinations(range(64), n)]
    signed = [mask - (1 << 64) if mask >> 63 else mask for mask in masks]
    return F.transform(F.array(*[F.lit(mask).cast("long") for mask in signed]), lambda mask: value.bitwiseXOR(mask))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, parent) links over distinct values of ``fingerprint`` that connect whatever lies within ``radius`` bits."""
    if radius not in (0, 2, 4):
        raise ValueError("the radius must be 0, 2 or 4")
    by_value = Window.partitionBy("variant").orderBy("node")
    return (
        prints.select(F.col("fingerprint").alias("node"))
        .withColumn("variant", F.explode(_variants(F.col("node"), radius // 2)))
        .withColumn("parent", F.first("node").over(by_value))
        .where(F.col("node") != F.col("parent"))
        .where(F.bit_count(F.col("node").bitwiseXOR(F.col("parent"))) <= radius)
        .select("node", "parent")
        .distinct()
    )


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, root, component_id, text_key of every row of ``docs`` (doc_id, text).

    ``root`` names the group, component_id is the smallest doc_id in it. Null texts count as
    empty, and all texts without words share fingerprint zero. A null doc_id is never the smallest; a group of
    only such rows has a null component_id. Repeated rows and ids are returned as often as given; rows are
    linked by their fingerprints alone. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    text = whole_text()
    rows = materialise(docs.select("doc_id", fingerprint(text).alias("fingerprint"), F.xxhash64(text).alias("text_key")))
    classes = materialise(rows.groupBy("fingerprint").agg(F.min("doc_id").cast("long").alias("id")))
    roots = components(links(classes, radius))
    rooted = materialise(
        classes.join(roots, classes["fingerprint"] == roots["node"], "left").select(
            "fingerprint", "id", F.coalesce("root", "fingerprint").alias("root")
        )
    )
    smallest = materialise(rooted.groupBy("root").agg(F.min("id").alias("component_id")))
    labels = materialise(rooted.join(smallest, "root").select("fingerprint", "root", "component_id"))
    return rows.join(labels, "fingerprint").select("doc_id", "fingerprint", "root", "component_id", "text_key")


def keep_smallest(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one row per group (doc_id, root, component_id, text_key), the one with the smallest doc_id; columns unchanged.

    Of several texts under that doc_id the one with the smallest hash stays, of repeated
    rows the one with the smallest other columns.
    """
    kept = (
        groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root", "doc_id", "text_key")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .groupBy("root", "doc_id")
        .agg(F.min(F.struct(F.col("text_key").alias("_key"), "_rows")).alias("_best"))
        .select("doc_id", "_best.*")
    )
    return keep_rows(docs, F.xxhash64(whole_text()), kept)


def drop_near_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row per group of near copies by fingerprint, the one with the smallest doc_id; columns unchanged."""
    return keep_smallest(docs, near_groups(docs, radius))
