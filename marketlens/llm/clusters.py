"""Centroid clustering with zone maps along a space-filling curve.

Vectors become whole numbers, are put in the order of a Hilbert curve and cut into blocks with the smallest
and largest value of every component, their box. Against a centroid, a box has a least and a greatest possible
distance; a centroid that is farther at least than another one is at most cannot be the nearest of any vector
in the block. Only the candidates that remain are compared, exactly and with all vectors of a block at once. Blocks
are written once and read by every round; a round sends one sum per task, cluster and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.sources.scratch import materialise

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
# Rows of a block, and bits of every component that the curve goes through.
BLOCK_ROWS = 256
CURVE_BITS = 4
# Bytes of a range partition of the curve.
PART_BYTES = 64 << 20
# Whole numbers beyond this have squared distances that a long cannot hold.
LIMIT = 1 << 27
# Below this, products and their sums are exact in double precision.
_EXACT = 1 << 22

_KEYED = "key binary, vec_id long, cells binary"
_BLOCKS = "vec_ids array<long>, cells binary, low binary, high binary"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve, as rows of bytes in order, of points with ``bits`` bits per component (Skilling's transform)."""
    x = [column.copy() for column in np.ascontiguousarray(cells.T, dtype=np.uint32)]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(len(x)):
            inverted = (x[i] & np.uint32(q)) != 0
            swapped = np.where(inverted, 0, (x[0] ^ x[i]) & p).astype(np.uint32)
            x[0] ^= np.where(inverted, p, swapped).astype(np.uint32)
            x[i] ^= swapped
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    q = top
    while q > 1:
        flips ^= np.where(x[-1] & np.uint32(q), np.uint32(q - 1), np.uint32(0)).astype(np.uint32)
        q >>= 1
    planes = [((column ^ flips) >> np.uint32(bit)) & np.uint32(1) for bit in range(bits - 1, -1, -1) for column in x]
    return np.packbits(np.stack(planes, axis=1).astype(np.uint8), axis=1)


def nearest(cells: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(candidates of the box, number of the nearest centroid of every row, squared distance); ties go to the smaller number."""
    below, above = low - centroids, centroids - high
    least = np.square(np.maximum(np.maximum(below, above), 0)).sum(axis=1)
    most = np.square(np.maximum(np.abs(below), np.abs(above))).sum(axis=1)
    candidates = np.flatnonzero(least <= most.min())
    chosen = centroids[candidates]
    if max(np.abs(low).max(), np.abs(high).max(), np.abs(chosen).max()) < _EXACT:
        rows, points = cells.astype(np.float64), chosen.astype(np.float64)
        distances = np.square(rows).sum(axis=1)[:, None] - 2 * (rows @ points.T) + np.square(points).sum(axis=1)
        distances = distances.astype(np.int64)
    else:
        distances = np.stack([np.square(cells - point).sum(axis=1) for point in chosen], axis=1)
    at = distances.argmin(axis=1)
    return candidates, candidates[at], distances[np.arange(len(cells)), at]


def _numbers(column: pa.Array, dimensions: int) -> np.ndarray:
    """A binary column of whole numbers as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(len(column), dimensions).astype(np.int64)


def _binaries(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    raw = np.ascontiguousarray(rows).tobytes()
    offsets = np.arange(0, len(raw) + 1, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def whole_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cells (floor(scale * x) of every component) of the vectors with exactly ``dimensions`` finite components."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    unusable = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = embeddings.where((F.size("embedding") == dimensions) & ~unusable)
    return kept.select(F.col("vec_id").cast("long"), F.transform(values, lambda x: F.floor(x * scale)).alias("cells"))


def _ranges(vectors: DataFrame, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Smallest and largest value and variance of every component, and the number of vectors."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cells").flatten().to_numpy().reshape(-1, dimensions)
            found = [cells.min(axis=0), cells.max(axis=0), cells.sum(axis=0, dtype=float), np.square(cells.astype(float)).sum(axis=0)]
            n = np.full(dimensions, len(cells))
            if state is None:
                state = [n, *found]
            else:
                low, high = np.minimum(state[1], found[0]), np.maximum(state[2], found[1])
                state = [state[0] + n, low, high, state[3] + found[2], state[4] + found[3]]
        if state is not None:
            names = ["dim", "n", "low", "high", "total", "squares"]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions)), *map(pa.array, state)], names=names)

    partial = vectors.select("cells").mapInArrow(measured, "dim long, n long, low long, high long, total double, squares double")
    # One row per component.
    rows = (
        partial.groupBy("dim")
        .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("t"), F.sum("squares").alias("s"))
        .orderBy("dim")
        .collect()
    )
    if not rows:
        return *(np.zeros(dimensions) for _ in range(3)), 0
    low, high = np.array([r.low for r in rows]), np.array([r.high for r in rows])
    if max(-low.min(), high.max()) >= LIMIT:
        raise ValueError(f"components must be below {LIMIT} after scaling, or distances exceed a long")
    variance = np.array([r.s / r.n - (r.t / r.n) ** 2 for r in rows])
    return low, high, variance, rows[0].n


def blocks_of(vectors: DataFrame, dimensions: int = DIMENSIONS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The table of blocks (vec_ids, cells, low, high) of ``vectors`` (vec_id, cells) in the order of the curve.

    The curve goes through the components with the largest variance first. Equal vectors are spread over
    partitions by their id and, where that repeats or is null, by their place in the input.
    """
    low, high, variance, rows = _ranges(vectors, dimensions)
    order = np.argsort(-variance, kind="stable")
    span = np.maximum(high - low + 1, 1)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cells").flatten().to_numpy().reshape(-1, dimensions)
            levels = ((cells - low) * (1 << CURVE_BITS) // span)[:, order]
            keys = hilbert_keys(levels, CURVE_BITS)
            columns = [_binaries(keys), batch.column("vec_id"), _binaries(cells.astype("<i4"))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "vec_id", "cells"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _numbers(batch.column("cells"), dimensions).astype("<i4")
            starts = list(range(0, len(cells), block_rows))
            parts = [cells[a : a + block_rows] for a in starts]
            offsets = pa.array([*starts, len(cells)], pa.int32())
            columns = [
                pa.ListArray.from_arrays(offsets, batch.column("vec_id")),
                pa.array([part.tobytes() for part in parts], pa.binary()),
                pa.array([part.min(axis=0).tobytes() for part in parts], pa.binary()),
                pa.array([part.max(axis=0).tobytes() for part in parts], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_ids", "cells", "low", "high"])

    table = materialise(vectors.mapInArrow(keyed, _KEYED).withColumn("place", F.monotonically_increasing_id()))
    parts = max(1, -(-rows * (dimensions * 5 + 64) // PART_BYTES), vectors.sparkSession.sparkContext.defaultParallelism)
    dealt = table.repartitionByRange(parts, "key", "vec_id", "place").sortWithinPartitions("key", "vec_id", "place")
    return materialise(dealt.select("vec_id", "cells").mapInArrow(cut, _BLOCKS))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The ``clusters`` vectors with the smallest SHA-256 of ``1:<vec_id>``, in that order; ties by components, null ids as no digits."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("digest"), "cells").orderBy("digest", "cells").limit(clusters).collect()
    return np.array([row["cells"] for row in rows], dtype=np.int64)


def _over_blocks(blocks: DataFrame, centroids: np.ndarray, use: Callable, schema: str) -> DataFrame:
    """``use`` on (ids, cells, candidates, nearest, distances) of every block; what it returns per task is its rows."""
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                lows, highs = _numbers(batch.column("low"), dimensions), _numbers(batch.column("high"), dimensions)
                for i, raw in enumerate(batch.column("cells")):
                    cells = np.frombuffer(raw.as_py(), dtype="<i4").reshape(-1, dimensions).astype(np.int64)
                    yield batch.column("vec_ids")[i].values, cells, *nearest(cells, lows[i], highs[i], centroids)

        yield from use(found())

    return blocks.mapInArrow(run, schema)


def refined(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of each one's vectors; those without vectors stay."""
    clusters, dimensions = centroids.shape

    def summed(found) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((clusters, dimensions), dtype=np.int64), np.zeros(clusters, dtype=np.int64)
        for _, cells, candidates, at, _ in found:
            for number in candidates.tolist():
                mine = cells if len(candidates) == 1 else cells[at == number]
                sums[number] += mine.sum(axis=0)
                counts[number] += len(mine)
        # The last column is the number of vectors.
        whole = np.column_stack([sums, counts])
        number, column = np.divmod(np.arange(whole.size), dimensions + 1)
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(column), pa.array(whole.reshape(-1))], names=["cluster", "dim", "total"])

    partial = _over_blocks(blocks, centroids, summed, "cluster long, dim long, total long")
    # One row per cluster and component.
    totals = partial.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    whole = {(row.cluster, row.dim): int(row.total) for row in totals}
    after = centroids.copy()
    for number in range(clusters):
        if n := whole.get((number, dimensions), 0):
            after[number] = [whole[number, d] // n for d in range(dimensions)]
    return after


def cluster(
    embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every usable row of ``embeddings`` (vec_id, embedding), and the final centroids.

    Vectors with another number of components, a null or a non-finite one are left out. Fewer usable
    vectors than ``clusters`` make as many clusters as there are; none, an empty table. Repeated rows and ids are
    returned as often as given, null ids too. Other columns are not read.
    """
    spark = embeddings.sparkSession
    vectors = whole_vectors(embeddings, dimensions, scale)
    centroids = first_centroids(vectors, clusters)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], schema), centroids.reshape(0, dimensions)
    blocks = blocks_of(vectors, dimensions)
    for _ in range(rounds):
        centroids = refined(blocks, centroids)

    def assigned(found) -> Iterator[pa.RecordBatch]:
        for ids, _, _, at, distances in found:
            columns = [ids, pa.array(at.astype(np.int32)), pa.array(distances)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return materialise(_over_blocks(blocks, centroids, assigned, schema)), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the distance summed over its cluster and over all, and the digest of its centroid."""
    # One row per cluster.
    totals = {row[0]: row[1] for row in assigned.groupBy("cluster").agg(F.sum("distance")).collect()}
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]

    def of_cluster(values: list, kind: str):
        return F.get(F.array(*[F.lit(value) for value in values]).cast(f"array<{kind}>"), F.col("cluster"))

    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster([totals.get(i, 0) for i in range(len(digests))], "long").alias("cluster_inertia"),
        F.lit(sum(totals.values())).cast("long").alias("inertia"),
        of_cluster(digests, "string").alias("centroid_sha256"),
    )
