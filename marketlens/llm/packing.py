"""Best-fit packing of token pieces into sequences of one length.

Pieces are range-sorted by length, longest first, and get their rank within their length; that is the distributed part,
one sort of narrow rows. Sequences with equal room are interchangeable, and so are pieces of equal length,
so the state of the packing is a list of runs: so many sequences with so much room. One step takes all pieces of
a length at once: a sweep finds the successor, the runs with the least room that still holds the length; pieces take the run's
places by rank, as many to a sequence as fit; the runs' room is updated, and the next shorter
length follows. What no run holds opens new sequences. This is best fit for pieces in
descending order, whatever their number. Runs and steps number at most a few thousand, bounded by the
capacity and not by the data; every piece looks its place up by (length, rank).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import bounded_batches, whole_text
from marketlens.llm.wordwise import CHUNK_BYTES, json_encoder, with_end
from marketlens.operators.numbering import with_position
from marketlens.sources.scratch import materialise

CAPACITY = 1024
# Pieces of words a task remembers: fewer than elsewhere, as packing shares its workers with the stages of the pipeline.
MAX_WORDS = 600_000
END_ID = 2


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Places for ``counts[length]`` pieces of each length: rows (length, first rank, pieces per sequence, first sequence, offset).

    A row holds until the next one of its length; piece ``rank`` goes to sequence ``first sequence + (rank - first rank)
    // pieces per sequence``. Rows are ordered by length and rank.
    """
    runs: list[tuple[int, int, int]] = []  # (room, first sequence, number of sequences), ascending
    places: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(runs, (length, -1, -1))
            if at < len(runs):
                room, sequence, number = runs.pop(at)
            else:
                each = capacity // length
                room, sequence, number = capacity, opened, -(-left // each)
                opened += number
            each = room // length
            places.append((length, rank, each, sequence, capacity - room))
            full = min(number, left // each)
            taken = full * each
            changed = []
            if full:
                changed.append((room - each * length, sequence, full))
            if full < number and left > taken:
                changed.append((room - (left - taken) * length, sequence + full, 1))
                taken = left
                full += 1
            if full < number:
                changed.append((room, sequence + full, number - full))
            for run in changed:
                if run[0]:
                    insort(runs, run)
            rank += taken
            left -= taken
    return np.asarray(sorted(places), dtype=np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every row of ``docs`` (doc_id, text).

    A document is its ids and ``end_id``. One longer than ``capacity`` is cut into pieces of that length, of which the first
    takes the rest and may be shorter. Null texts count as empty: the end id alone.
    """
    bounded_batches(docs.sparkSession, rows=1000, size=CHUNK_BYTES)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = json_encoder(vocabulary)
        encoder.max_words = MAX_WORDS
        for batch in batches:
            whole, sizes = with_end(*encoder.flat(batch["text"].tolist()), end_id)
            # Of each document: its pieces, the length of the first one, and where it begins.
            times, first, begins = -(-sizes // capacity), (sizes - 1) % capacity + 1, np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(sizes)), times)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            at = begins[row] + start
            raw = memoryview(whole.view(np.uint8))
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            ids = batch["doc_id"].astype("Int64").mask(batch["missing"])
            columns = {"doc_id": ids.array[row], "piece": piece, "start": start, "length": length, "ids_crc32": sums}
            yield pd.DataFrame(columns).astype({"piece": "int32", "ids_crc32": "int64"})
        # The worker lives on for other stages, which need the memory.
        encoder.forget()

    doc_id = F.col("doc_id").cast("long")
    chosen = docs.select(
        F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("missing"), whole_text().alias("text")
    )
    return chosen.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of ``docs`` with its sequence_id and offset there; sequences are filled without gaps from 0.

    Repeated rows are packed each; ties go by doc_id, piece and checksum. An empty table gives an empty result. Other
    columns are not read.
    """
    found = materialise(pieces(docs, vocabulary, capacity, end_id))
    ranked = with_position(found, [F.col("length").desc(), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")])
    # One row per length, at most ``capacity`` of them.
    counts = {row[0]: row[1] for row in found.groupBy("length").agg(F.count(F.lit(1))).collect()}
    places = best_fit(counts, capacity)
    ahead, total = {}, 0
    for length in sorted(counts, reverse=True):
        ahead[length] = total
        total += counts[length]
    before = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in ahead.items():
        before[length] = n
    # Places in one ascending order: by length, then rank.
    keys = places[:, 0] * (total + 1) + places[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, position: pd.Series) -> pd.DataFrame:
        lengths = length.to_numpy()
        rank = position.to_numpy() - before[lengths]
        at = np.searchsorted(keys, lengths * (total + 1) + rank, side="right") - 1
        row = places[at]
        beyond = rank - row[:, 1]
        return pd.DataFrame(
            {"sequence_id": row[:, 3] + beyond // row[:, 2], "offset": row[:, 4] + beyond % row[:, 2] * lengths}
        )

    placed = ranked.withColumn("_place", place("length", "position"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset")
