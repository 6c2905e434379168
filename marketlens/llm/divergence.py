"""How far the sources of a language differ in their use of terms.

Terms are found and counted in packed form: the bytes of many texts are looked at at once, terms of up to 8 bytes
become one 64-bit word, those of up to 16 bytes two, radix-sorted and counted as runs; longer terms are sorted as bytes in
buckets of similar length. What a task has counted is summed by Spark. The distances between all sources of a
language then come from blocks of terms: a block holds the shares of its terms in every source, and
adds its part to every pair of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import bounded_batches, whole_text
from marketlens.sources.scratch import materialise

# Documents of a language that must hold a term, what is added to every count, and the unit of shares.
MIN_DOCUMENTS = 30
SMOOTHING = 5
UNIT = 1_000_000_000
TOP_TERMS = 50
# Bytes of text counted at once, and cells (terms times sources) of a block.
CHUNK_BYTES = 8 << 20
BLOCK_CELLS = 1 << 18

# A term is a run of these bytes: letters A-Z and a-z, and all of what is not ASCII. Small letters stand for A-Z.
_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_MASKS = np.array([(1 << 64) - (1 << (64 - 8 * n)) for n in range(9)], dtype=np.uint64)
_COUNTED = "lang string, source string, term string, n long, docs long"


def _radix_order(words: list[np.ndarray]) -> np.ndarray:
    """A stable order of rows of 64-bit words, the first word first: least digit first, 16 bits at a time."""
    order = None
    for word in reversed(words):
        for shift in range(0, 64, 16):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit[0] == digit).all():
                continue
            # numpy sorts 16-bit numbers stably by radix.
            step = np.argsort(digit if order is None else digit[order], kind="stable")
            order = step if order is None else order[step]
    return np.arange(len(words[0])) if order is None else order



def _counted_runs(new_term: np.ndarray, docs: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, rows, documents) of every run of one term in one group, of rows sorted by term, group and document."""
    new_doc = new_term | (np.diff(docs) != 0)
    new_group = new_term | (np.diff(groups) != 0)
    starts = np.flatnonzero(np.concatenate([[True], new_group]))
    rows = np.diff(np.append(starts, len(docs)))
    documents = np.add.reduceat(np.concatenate([[1], new_doc.astype(np.int64)]), starts)
    return starts, rows, documents


def _packed_strings(words: list[np.ndarray], lengths: np.ndarray) -> pa.Array:
    """Terms back from their words."""
    wide = np.stack(words, axis=1).astype(">u8").view(np.uint8).reshape(len(lengths), -1)
    data = wide[np.arange(wide.shape[1]) < lengths[:, None]]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def count_terms(raw: np.ndarray, ends: np.ndarray, groups: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, group, occurrences, documents) of texts whose bytes follow each other in ``raw``, by bucket of term lengths.

    ``ends`` are the ends of the texts, ``groups`` ascending numbers of what each is counted for. Every
    (term, group) comes once.
    """
    inside = _IN_TERM[raw]
    # A term also ends where its text does.
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begins = np.concatenate([[0] if len(raw) and inside[0] else [], edge[inside[edge]]]).astype(np.int64)
    stops = np.concatenate([edge[~inside[edge]], [len(raw)] if len(raw) and inside[-1] else []]).astype(np.int64)
    cuts = ends[:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]])
    begins, stops = np.sort(np.concatenate([begins, cuts])), np.sort(np.concatenate([stops, cuts]))
    lengths = stops - begins
    docs = np.searchsorted(ends, begins, side="right")
    lower = np.concatenate([_LOWER[raw], np.zeros(16, dtype=np.uint8)])
    # Eight bytes from every place on, the first one highest.
    eights = np.ndarray((len(lower) - 7,), dtype=">u8", buffer=lower, strides=(1,))

    for least, most in ((1, 8), (9, 16)):
        chosen = np.flatnonzero((lengths >= least) & (lengths <= most))
        if not len(chosen):
            continue
        size, at = lengths[chosen], begins[chosen]
        words = [eights[at].astype(np.uint64) & _MASKS[np.minimum(size, 8)]]
        if most > 8:
            words.append(eights[at + 8].astype(np.uint64) & _MASKS[size - 8])
        order = _radix_order(words)
        words = [word[order] for word in words]
        new_term = np.any([word[1:] != word[:-1] for word in words], axis=0)
        doc = docs[chosen][order]
        starts, rows, documents = _counted_runs(new_term, doc, groups[doc])
        yield _packed_strings([word[starts] for word in words], size[order][starts]), groups[doc[starts]], rows, documents

    # Buckets of terms that are up to twice as long as the shortest of the bucket.
    longer = np.flatnonzero(lengths > 16)
    bucket = np.ceil(np.log2(lengths[longer])).astype(int) if len(longer) else longer
    for width in np.unique(bucket).tolist():
        chosen = longer[bucket == width]
        terms = np.array([lower[a:b].tobytes() for a, b in zip(begins[chosen].tolist(), stops[chosen].tolist())], dtype="S")
        order = np.argsort(terms, kind="stable")
        terms, doc = terms[order], docs[chosen][order]
        starts, rows, documents = _counted_runs(terms[1:] != terms[:-1], doc, groups[doc])
        yield pa.array(terms[starts].tolist(), pa.binary()).cast(pa.string()), groups[doc[starts]], rows, documents


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and documents with one, of every term in every group.

    A group without terms has one row with an empty term. Sums of what tasks have counted for every
    ``CHUNK_BYTES`` of text; a longer text is counted alone.
    """
    bounded_batches(docs.sparkSession, rows=2000)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[tuple[str, str], bytes]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda row: row[0])
            names = sorted({name for name, _ in held})
            number = {name: i for i, name in enumerate(names)}
            raw = np.frombuffer(b"".join(text for _, text in held), dtype=np.uint8)
            ends = np.cumsum([len(text) for _, text in held])
            groups = np.array([number[name] for name, _ in held])
            held.clear()
            langs, sources = pa.array([a for a, _ in names], pa.string()), pa.array([b for _, b in names], pa.string())
            zeros = np.zeros(len(names), dtype=np.int64)
            marks = (pa.array([""] * len(names), pa.string()), np.arange(len(names)), zeros, zeros)
            for terms, group, n, documents in (marks, *count_terms(raw, ends, groups)):
                at = pa.array(group)
                columns = [langs.take(at), sources.take(at), terms, pa.array(n), pa.array(documents)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, batch.column("text").cast(pa.binary())):
                held.append(((lang, source), text.as_py()))
                size += len(held[-1][1])
                if size >= CHUNK_BYTES:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    chosen = docs.select(whole_text("lang").alias("lang"), whole_text("source").alias("source"), whole_text().alias("text"))
    partial = chosen.mapInArrow(counted, _COUNTED)
    return partial.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * count / total), exact: the product has more digits than a long."""
    unit, whole = F.lit(UNIT).cast("decimal(10,0)"), total.cast("decimal(19,0)")
    product = unit * count.cast("decimal(19,0)")
    return F.call_function("div", product, whole) + 1


def shares(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(terms, groups): the kept terms that occur in a group, and all groups.

    terms: lang, source, term, share, lang_share. groups: lang, source, terms (kept ones of the language), zero (the share of a term
    that the group has not). A language keeps the terms that ``min_documents`` of its documents hold.
    """
    counts = materialise(term_counts(docs))
    by_term = Window.partitionBy("lang", "term")
    kept = (
        counts.where("term <> ''")
        .select("*", F.sum("docs").over(by_term).alias("lang_docs"), F.sum("n").over(by_term).alias("lang_n"))
        .withColumn("first", F.col("source") == F.min("source").over(by_term))
        .where(F.col("lang_docs") >= min_documents)
    )
    kept = materialise(kept.select("lang", "source", "term", "n", "lang_n", "first"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("terms"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    found = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.lit(0)
    terms = F.coalesce("terms", zero)
    bottom = F.greatest(F.coalesce("total", zero) + SMOOTHING * terms, F.lit(1))
    lang_bottom = F.greatest(F.coalesce("lang_total", zero) + SMOOTHING * terms, F.lit(1))
    # One row per group.
    groups = materialise(
        found.select(
            "lang", "source", terms.alias("terms"), bottom.alias("bottom"), lang_bottom.alias("lang_bottom"), _share(F.lit(SMOOTHING), bottom).alias("zero")
        )
    )
    joined = kept.join(groups.drop("terms", "zero"), ["lang", "source"])
    share = _share(F.col("n") + SMOOTHING, F.col("bottom"))
    lang_share = _share(F.col("lang_n") + SMOOTHING, F.col("lang_bottom"))
    terms = joined.select("lang", "source", "term", share.alias("share"), lang_share.alias("lang_share"))
    return materialise(terms), groups.select("lang", "source", "terms", "zero")


def _pair_sums(key, terms: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Distances between all sources of a language over one block of its terms."""
    names = np.array(sorted(groups["source"]), dtype=object)
    number = {name: i for i, name in enumerate(names)}
    codes, found = pd.factorize(terms["term"])
    zero = groups.set_index("source")["zero"].reindex(names).to_numpy(dtype=np.int64)
    matrix = np.repeat(zero[:, None], len(found), axis=1)
    matrix[terms["source"].map(number).to_numpy(dtype=np.int64), codes] = terms["share"].to_numpy(dtype=np.int64)
    n, sums = len(names), []
    for i in range(n - 1):
        # Beyond the terms of the block, what the two shares of absent terms differ by is taken off; it is added for all terms later.
        sums.append((np.abs(matrix[i + 1 :] - matrix[i]) - np.abs(zero[i + 1 :] - zero[i])[:, None]).sum(axis=1))
    first, second = np.triu_indices(n, 1)
    columns = {"lang": np.full(len(first), key[0], dtype=object), "source": names[first], "item": names[second]}
    return pd.DataFrame(columns, dtype=object).assign(value=np.concatenate([np.zeros(0, dtype=np.int64), *sums]))


def pair_distances(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the summed differences of shares, for every source and every other one of its language."""
    # One number: the cells of the largest language decide how many blocks its terms are dealt to.
    cells = groups.groupBy("lang").agg((F.max("terms") * F.count(F.lit(1))).alias("cells")).agg(F.max("cells")).first()[0]
    blocks = max(1, -(-(cells or 0) // BLOCK_CELLS))
    dealt = terms.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)))
    per_block = groups.select("lang", "source", "zero", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    sums = (
        dealt.groupBy("lang", "block")
        .cogroup(per_block.groupBy("lang", "block"))
        .applyInPandas(_pair_sums, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
    )
    mine = groups.select("lang", "source", "terms", F.col("zero").alias("zero"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    whole = sums.join(mine, ["lang", "source"]).join(other, ["lang", "item"])
    value = F.col("value") + F.col("terms") * F.abs(F.col("zero") - F.col("other"))
    upper = materialise(whole.select("lang", "source", "item", value.alias("value")))
    return upper.unionByName(upper.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: for every group of ``docs`` (text, lang, source) its distance to
    every other source of its language (part ``pair``), and the terms it uses most beyond its language (part ``term``).

    Null texts, languages and sources count as empty. A language without kept terms has distances of 0; one source
    alone has no pair. Ties rank by the item's bytes. An empty table gives an empty result. Other columns are not read.
    """
    terms, groups = shares(docs, min_documents)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pair_distances(terms, groups).withColumn("rank", F.row_number().over(order))
    above = terms.where("share > lang_share").select("lang", "source", F.col("term").alias("item"), (F.col("share") - F.col("lang_share")).alias("value"))
    top = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)

    def part(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")

    return part(pairs, "pair").unionByName(part(top, "term"))
