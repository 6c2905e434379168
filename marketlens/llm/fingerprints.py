"""Bottom-k sketches of word shingles.

A fingerprint is the sorted array of the k smallest 64-bit hashes of a text's shingles.
It is built row by row with built-in functions, so a document never leaves its task.
Sketches of parts merge into the sketch of the whole, and two sketches alone estimate resemblance,
containment and the number of distinct shingles.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import lower_ascii, whole_text

K = 128
WORDS = 5
SPACE = "[\\x20\\x09-\\x0D]+"
# Buckets of the range that orders documents; their number follows the session's
# shuffle partitions, their bounds the quantiles of doc_id.
_ACCURACY = 20_000
# Bytes at the start of a text by which the rows of one frequent doc_id are divided.
_START_BYTES = 7


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The bottom-k sketch of a text: at most ``k`` distinct hashes, ascending.

    Words are runs of other characters than ASCII white space, A-Z in lower case; a shingle is
    ``words`` words in a row. A text of fewer words has one shingle, all its
    words; one without words (or null) has an empty sketch.
    """
    found = F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SPACE), lambda word: word != "")
    hashed = F.transform(found, lambda word: F.xxhash64(word))

    def shingles(all_words: Column) -> Column:
        positions = F.sequence(F.lit(0), F.greatest(F.size(all_words) - words, F.lit(0)))
        # Positions beyond the end are null, which a hash of several values skips.
        each = F.transform(positions, lambda i: F.xxhash64(*[F.get(all_words, i + n) for n in range(words)]))
        return F.when(F.size(all_words) > 0, each).otherwise(F.array().cast("array<bigint>"))

    # transform() over a one-element array names the word hashes, so they are computed once.
    whole = F.element_at(F.transform(F.array(hashed), shingles), 1)
    return F.slice(F.sort_array(F.array_distinct(whole)), 1, k)


def merge(left: Column, right: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(left, right)), 1, k)


def merge_groups(parts: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """One merged sketch per ``key``; no task ever holds more than k hashes of a key.

    The rank limit runs in the map tasks first, so a key with a third of the rows moves at most
    k hashes per task. A key with only empty sketches gets an empty one.
    """
    hashes = parts.select(key, F.explode(column).alias("_hash"))
    for salt in (F.pmod(F.xxhash64("_hash"), F.lit(64)), None):
        hashes = hashes.distinct()
        by = [key] if salt is None else [key, salt]
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("_hash"))
        hashes = hashes.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
    gathered = hashes.groupBy(key).agg(F.sort_array(F.collect_list("_hash")).alias(column))
    empty = F.array().cast("array<bigint>")
    # Renamed: both sides derive from the same table.
    keys = parts.select(F.col(key).alias("_key")).distinct()
    return keys.join(gathered, keys["_key"].eqNullSafe(gathered[key]), "left").select(
        F.col("_key").alias(key), F.coalesce(column, empty).alias(column)
    )


def resemblance(left: Column, right: Column, k: int = K) -> Column:
    """Estimate of the Jaccard resemblance: the share of the union's k smallest hashes that both have.

    Two empty sketches are alike (1), an empty and another are not (0).
    """
    both = F.array_intersect(left, right)
    union = merge(left, right, k)
    share = F.size(F.array_intersect(union, both)) / F.size(union)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(share)


def distinct_count(column: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles: exact below k, else (k - 1) over the k-th hash's part of the range."""
    part = (F.element_at(column, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(column) < k, F.size(column).cast("double")).otherwise((k - 1) / part)


def containment(left: Column, right: Column, k: int = K) -> Column:
    """Estimate of the part of ``left``'s shingles that ``right`` has; an empty ``left`` is contained (1)."""
    common = resemblance(left, right, k) * distinct_count(merge(left, right, k), k)
    part = F.least(common / distinct_count(left, k), F.lit(1.0))
    return F.when(F.size(left) == 0, F.lit(1.0)).otherwise(part)


def as_text(column: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits per hash."""
    return F.array_join(F.transform(column, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _count_below(edges: Column, value: Column) -> Column:
    return F.size(F.filter(edges, lambda edge: edge < value))


def range_bucket(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` lie below ``value`` (null: -1), looking at 2 * sqrt(n) of them."""
    if not cuts:
        return F.when(value.isNull(), -1).otherwise(0)
    step = math.isqrt(len(cuts)) or 1
    coarse = _count_below(F.lit(cuts[step - 1 :: step]), value)
    fine = _count_below(F.slice(F.lit(cuts), coarse * step + 1, F.lit(step)), value)
    return F.when(value.isNull(), -1).otherwise((coarse * step + fine).cast("int"))


def _start(text: Column) -> Column:
    """The first bytes of a text as a number; numbers are in the order of the texts."""
    first = F.hex(F.substring(F.encode(text, "UTF-8"), 1, _START_BYTES))
    return F.conv(F.rpad(first, 2 * _START_BYTES, "0"), 16, 10).cast("long")


def _slices(ids: DataFrame, frequent: dict[int | None, int]) -> dict[int | None, list[int]]:
    """Ascending starts of texts that divide the rows of each frequent doc_id (null: None) into about as many slices as asked for."""
    most = max(frequent.values())
    # Bounded: as many ids as fill a bucket, each with that many numbers.
    rows = (
        ids.where(F.col("doc_id").isin([one for one in frequent if one is not None]) | F.col("doc_id").isNull())
        .groupBy("doc_id")
        .agg(F.percentile_approx(_start(F.col("text")), [i / most for i in range(1, most)], F.lit(_ACCURACY)).alias("starts"))
        .collect()
    )
    found = {}
    for row in rows:
        wanted = frequent.get(row["doc_id"], 1)
        found[row["doc_id"]] = sorted({row["starts"][i * most // wanted - 1] for i in range(1, wanted)})
    return found


def _buckets(ids: DataFrame, buckets: int) -> Column:
    """The number of a row's range, ascending by doc_id and text; null doc_ids come first.

    Bounds are quantiles of doc_id. One that is a bound several times fills several ranges: it gets ranges of its own, divided by
    the starts of texts, and so do null doc_ids. Only rows with one doc_id whose texts begin alike share a range whatever their number.
    """
    if buckets < 2:
        return range_bucket(F.col("doc_id"), [])
    shares = [i / buckets for i in range(1, buckets)]
    numbers = ids.agg(
        F.percentile_approx("doc_id", shares, F.lit(_ACCURACY)).alias("bounds"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("doc_id").isNull()).alias("nulls"),
    ).first()
    bounds = numbers["bounds"] or []
    frequent: dict[int | None, int] = {one: times for one, times in Counter(bounds).items() if times > 1}
    if numbers["nulls"] * buckets > numbers["rows"]:
        frequent[None] = -(-numbers["nulls"] * buckets // numbers["rows"])
    # Below a frequent id ends the range before it.
    cuts = sorted(set(bounds) | {one - 1 for one in frequent if one is not None and one > -(2**63)})
    bucket = range_bucket(F.col("doc_id"), cuts)
    if not frequent:
        return bucket
    starts = {(-1 if one is None else cuts.index(one)): found for one, found in _slices(ids, frequent).items() if found}
    if not starts:
        return bucket
    listed = F.create_map(*[part for at, found in starts.items() for part in (F.lit(at), F.lit(found))])
    own = F.element_at(listed, bucket)
    within = F.when(own.isNotNull(), _count_below(own, _start(F.col("text")))).otherwise(0)
    # Numbers without gaps, from -1: slices move the numbers of all later ranges.
    first = accumulate((1 + len(starts.get(at, [])) for at in range(-1, len(cuts))), initial=-1)
    return F.get(F.lit(list(first)), bucket + 1) + within


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, doc_id, text) with the text of the next document by descending doc_id, the first's after the last.

    Documents are dealt by ranges of doc_id and, where many share one or have none, of text (as even as the quantiles),
    so each text moves once and no task sees all of them. The head of every range is also copied to the end of the range that precedes it.
    Null doc_ids come last; ties are ordered by the text. A single document is its own next one.
    Rows of later windows over the same bucket and order need no new exchange.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    placed = ids.withColumn("bucket", _buckets(ids, buckets))
    # One row of numbers per bucket. Its head is the row with the largest id and, of ties, the largest text.
    start = _start(F.col("text"))
    tops = placed.groupBy("bucket").agg(F.max(F.struct("doc_id", start.alias("start"))).alias("top")).collect()
    present = sorted((row["bucket"] for row in tops), reverse=True)
    before = {bucket: present[i - 1] for i, bucket in enumerate(present)}
    targets = spark.createDataFrame(
        [(row["bucket"], row["top"]["doc_id"], row["top"]["start"], before[row["bucket"]]) for row in tops],
        "_bucket int, _top long, _start long, _target int",
    )
    is_top = (F.col("bucket") == F.col("_bucket")) & F.col("doc_id").eqNullSafe(F.col("_top")) & (start == F.col("_start"))
    heads = (
        placed.join(F.broadcast(targets), is_top)
        .groupBy(F.col("_target").alias("bucket"), "doc_id")
        .agg(F.max("text").alias("text"))
        .withColumn("_copy", F.lit(True))
    )
    # A partition for every bucket: the session's number of them would hold more the longer the table is.
    dealt = placed.withColumn("_copy", F.lit(False)).unionByName(heads).repartition(buckets, "bucket")
    return dealt.withColumn("next_text", F.lead("text").over(_order()))


def _order():
    return Window.partitionBy("bucket").orderBy("_copy", F.col("doc_id").desc_nulls_last(), F.col("text").desc())


def edited_pairs(docs: DataFrame, buckets: int, k: int = K) -> DataFrame:
    """Every document beside its edited text and its next document, as sketches.

    The edited text has the last floor(n/3) of its n code points replaced by as many first code points (or all)
    of the next document. Columns: doc_id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch. Null texts count as
    empty; an empty table gives an empty result.
    """
    paired = with_next(docs, buckets).withColumn("sketch", sketch(F.col("text"), k))
    # Computed from the copied head too, so the next sketch is never built twice.
    paired = paired.withColumn("next_sketch", F.lead("sketch").over(_order())).where(~F.col("_copy"))
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - third), F.substring("next_text", F.lit(1), third))
    return paired.withColumn("_edited", edited).select(
        "doc_id",
        size.cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        "sketch",
        sketch(F.col("_edited"), k).alias("edited_sketch"),
        "next_sketch",
    )
