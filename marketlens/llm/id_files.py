"""Token ids in binary files: frequency-ranked, byte-aligned, with control bytes of their own.

Ids are replaced by their rank of frequency in the whole corpus, so that the commonest 256 take one byte;
``codebook`` lists the ids by rank. A row of ``segments`` is one run of consecutive documents. ``control`` has two
bits per id, the number of bytes less one, four ids to a byte; ``data`` has the bytes. A segment can be
read alone with the codebook; a lost task writes its own again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.common import bounded_batches, text_parts, whole_text
from marketlens.llm.wordwise import CHUNK_BYTES, json_encoder, with_end
from marketlens.sources.scratch import materialise, scratch_scope

END_ID = 0
# Ids after which a segment ends with the document it holds.
SEGMENT_IDS = 1 << 20
# Characters of a text by which documents with the same doc_id are dealt.
_TIE_CHARS = 64
_WIDTHS = np.arange(4)
# For every control byte, the byte counts of its four ids.
_LENGTHS = ((np.arange(256)[:, None] >> (2 * _WIDTHS)) & 3) + 1


def ranking(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``values`` by descending count, equal ones ascending."""
    return values[np.lexsort((values, -counts))].astype("<u4")


def encode_ids(ids: np.ndarray, codebook: np.ndarray | None = None) -> tuple[bytes, bytes, bytes]:
    """(codebook, control, data) of an array of unsigned ids; without a codebook, by their own frequency."""
    if codebook is None:
        codebook = ranking(*np.unique(ids, return_counts=True))
    order = np.argsort(codebook, kind="stable").astype("<u4")
    if len(codebook) and codebook.max() < 1 << 24:
        rank_of = np.zeros(int(codebook.max()) + 1, dtype="<u4")
        rank_of[codebook] = np.arange(len(codebook), dtype="<u4")
        ranks = rank_of[ids]
    else:
        ranks = order[np.searchsorted(codebook[order], ids)] if len(ids) else np.zeros(0, dtype="<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[_WIDTHS <= extra[:, None]]
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    padded[: len(ranks)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return codebook.tobytes(), control.tobytes(), data.tobytes()


def decode_ids(codebook: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ids again: lengths from the table of control bytes, then a masked gather."""
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths) - lengths
    # Three bytes of padding let every gather read four.
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    ranks = raw[starts].astype("<u4")
    longer = np.arange(n)
    for width in range(1, 4):
        longer = longer[lengths[longer] > width]
        ranks[longer] |= raw[starts[longer] + width].astype("<u4") << np.uint32(8 * width)
    return np.frombuffer(codebook, dtype="<u4")[ranks]


_DOCS = "shard int, segment int, first long, n_ids long, doc_ids array<long>, lengths array<long>"
_SPOOL = f"{_DOCS}, ids binary"
_SEGMENT = f"{_DOCS}, control binary, data binary"
_CODEBOOK = "rank int, id long"


def _spool(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Segments of plain ids (16 bits where they fit) in the order of the files."""
    bounded_batches(docs.sparkSession, rows=1000, size=CHUNK_BYTES)
    columns = [part.split()[0] for part in _SPOOL.split(", ")]

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = json_encoder(vocabulary)
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        held, sizes, names, total = [], [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal number, first, held, sizes, names, total
            row = (shard, number, first, total, names, np.concatenate(sizes).tolist(), np.concatenate(held).tobytes())
            number, first, held, sizes, names, total = number + 1, first + total, [], [], [], 0
            return pd.DataFrame({name: [value] for name, value in zip(columns, row)})

        for batch in batches:
            ids, lengths = with_end(*encoder.flat(batch["text"].tolist()), end_id)
            ids = ids.astype(encoder.type, copy=False)
            found = [None if missing else doc_id for missing, doc_id in zip(batch["missing"].tolist(), batch["doc_id"].tolist())]
            ends, begin = np.cumsum(lengths), 0
            while begin < len(lengths):
                before = int(ends[begin - 1]) if begin else 0
                # A segment ends with the document that fills it.
                upto = min(int(np.searchsorted(ends, before + SEGMENT_IDS - total)) + 1, len(lengths))
                held.append(ids[before : ends[upto - 1]])
                sizes.append(lengths[begin:upto])
                names += found[begin:upto]
                total += len(held[-1])
                begin = upto
                if total >= SEGMENT_IDS:
                    yield flush()
        if names:
            yield flush()

    doc_id, text = F.col("doc_id").cast("long"), whole_text()
    chosen = docs.select(
        F.coalesce(doc_id, F.lit(0)).alias("doc_id"),
        doc_id.isNull().alias("missing"),
        text.alias("text"),
        F.substring(text, 1, _TIE_CHARS).alias("start"),
        F.xxhash64(text).alias("hash"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = [F.col("missing").desc(), "doc_id", "start", "hash", "place"]
    dealt = chosen.repartitionByRange(text_parts(docs), *order).sortWithinPartitions(*order)
    return materialise(dealt.select("doc_id", "missing", "text").mapInPandas(segments, _SPOOL))


def corpus_ranking(spool: DataFrame, kind: np.dtype) -> np.ndarray:
    """All ids of the corpus by descending frequency; as many rows as the vocabulary has reach the driver."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for raw in batch["ids"]:
                more = np.bincount(np.frombuffer(raw, dtype=kind))
                if len(more) > len(counts):
                    counts, more = more, counts
                counts[: len(more)] += more
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"id": used, "n": counts[used]})

    rows = spool.select("ids").mapInPandas(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return ranking(np.array([row.id for row in rows], dtype=np.int64), np.array([row.n for row in rows], dtype=np.int64))


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Write the ids of every row of ``docs`` (doc_id, text), each document followed by ``end_id``, by ascending doc_id.

    Documents are dealt by ranges of doc_id and sorted, so texts move once; shards (range partitions)
    and their segments are in that order. Null doc_ids come first. Ties are ordered by the first characters of the text, then its
    hash, and spread over partitions by that order. Null texts count as empty and leave the end id alone; an empty table leaves no
    segments. A document is never divided, so a segment is as long as ``SEGMENT_IDS`` and one document at most.
    """
    spark = docs.sparkSession
    with scratch_scope(spark):
        spool = _spool(docs, vocabulary, end_id)
        kind = json_encoder(vocabulary).type
        codebook = corpus_ranking(spool, kind)

        def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [encode_ids(np.frombuffer(raw, dtype=kind), codebook)[1:] for raw in batch["ids"]]
                yield batch.drop(columns="ids").assign(control=[a for a, _ in found], data=[b for _, b in found])

        bounded_batches(spark, rows=4)
        spool.mapInPandas(coded, _SEGMENT).write.parquet(f"{path}/segments")
    ranked = spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(codebook)), "id": codebook.astype(np.int64)}), _CODEBOOK)
    ranked.coalesce(1).write.parquet(f"{path}/codebook")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, read from the files."""
    bounded_batches(spark, rows=4)
    stored = spark.read.schema(_SEGMENT).parquet(f"{path}/segments")
    # As many rows as the vocabulary has.
    ranked = spark.read.schema(_CODEBOOK).parquet(f"{path}/codebook").orderBy("rank").collect()
    codebook = np.array([row["id"] for row in ranked], dtype="<u4").tobytes()
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard; shards are partitions of the writing job.
    shards = stored.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    offsets = shards.select(
        F.col("shard").alias("_shard"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset")
    )
    placed = stored.join(F.broadcast(offsets), F.col("shard") == F.col("_shard"))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids = decode_ids(codebook, row.control, row.data, row.n_ids)
                ends = np.cumsum(row.lengths)
                starts = ends - row.lengths
                raw = memoryview(ids.view(np.uint8))
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(list(row.doc_ids), dtype="Int64"),
                        "start": starts + (row.offset + row.first),
                        "n_tokens": row.lengths,
                        "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())],
                    }
                )

    chosen = placed.select("first", "offset", "n_ids", "doc_ids", "lengths", "control", "data")
    return chosen.mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
