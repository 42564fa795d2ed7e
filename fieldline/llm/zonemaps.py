"""Centroid clustering (Lloyd's rounds) in whole numbers over space-filling-curve zone maps.

Vectors are laid out along a Hilbert curve through all dimensions, so that
neighbours in the table are neighbours in space, and packed into blocks; each
block carries the least and largest value of every component (its box). In each
round the distances from a centroid to the nearest and the farthest point of a
box bound all distances in the block: a centroid whose nearest is beyond another
one's farthest serves no vector there. Only the others are compared, exactly, a
whole block at a time; a block with one such centroid gives its stored sum
without a comparison.

The layout decides how much is compared, never the result. Equal vectors, of
which a third of the table may consist, are dealt by a second key. Rounds read
the stored blocks and send k sums per task, which Spark adds; centroids (k x
LENGTH numbers) are all that reaches the driver.

Defined results: null vectors, vectors of another length and those with null or
non-finite components are left out; the first centroids are the rows least by
(hash of the id, id, components), rows without an id last; with fewer rows than
k there are fewer centroids; equal centroids are legal, the smaller number
wins every tie; repeated rows are vectors of their own; sums and distances
beyond a long count as the largest long; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldline.llm.batches import map_batches
from fieldline.llm.vectors import LONG, as_long, blocks, exact_kind, ids_of, largest, matrix, unpacked, whole_vectors
from fieldline.session import discard, materialise

K = 8
ROUNDS = 10
SCALE = 1024
LENGTH = 64
SEED = 3
CURVE_BITS = 4
BLOCK_ROWS = 1024


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place on the Hilbert curve of rows of cell numbers below 2^bits: coordinates turned, Gray-coded, their bits dealt in turn."""
    axes = [c.astype(np.uint32) for c in cells.T]
    if not axes:
        return [b""] * len(cells)
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i, axis in enumerate(axes):
            upper = (axis & bit) != 0
            swap = np.where(upper, 0, (axes[0] ^ axis) & below).astype(np.uint32)
            axes[0] = axes[0] ^ np.where(upper, below, swap).astype(np.uint32)
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), dtype=np.uint32)
    for level in range(bits - 1, 0, -1):
        turn = np.where((axes[-1] >> np.uint32(level)) & 1, turn ^ np.uint32((1 << level) - 1), turn).astype(np.uint32)
    dealt = [((a ^ turn) >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1) for a in axes]
    return [row.tobytes() for row in np.packbits(np.stack(dealt, axis=1).astype(np.uint8), axis=1)]


def along_curve(vectors: DataFrame, length: int, low: int, high: int, bits: int = CURVE_BITS) -> DataFrame:
    """``vectors`` (vec_id, x) ranged and sorted along the curve over [low, high]; equal places are dealt by the id."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("place", T.BinaryType())])

    def run(batches):
        for batch in batches:
            share = (matrix(batch.column(1), length).astype(float) - low) / max(1, high - low)
            cells = np.clip(share * (1 << bits), 0, (1 << bits) - 1).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(cells, bits), pa.binary())], names=schema.names)

    placed = map_batches(vectors, run, schema).withColumn("deal", F.xxhash64("vec_id", F.monotonically_increasing_id()))
    return placed.repartitionByRange("place", "deal").sortWithinPartitions("place", "deal").drop("place", "deal")


def candidate_centroids(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some point of the box, ascending."""
    kind = np.int64 if 4 * max(1, len(low)) * max(largest(low), largest(high), largest(centroids)) ** 2 <= LONG else object
    low, high, c = low.astype(kind), high.astype(kind), centroids.astype(kind)
    outside = np.maximum(np.maximum(low - c, c - high), 0)
    nearest, farthest = (outside**2).sum(axis=1), (np.maximum(abs(c - low), abs(high - c)) ** 2).sum(axis=1)
    return np.flatnonzero(nearest <= farthest.min())


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, one column per centroid."""
    kind = exact_kind(4 * max(1, x.shape[1]) * max(largest(x), largest(centroids)) ** 2)
    kind = np.float64 if kind is np.float32 else kind
    x, c = x.astype(kind), centroids.astype(kind)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller of equal ones) and its squared distance."""
    found = distances(x, centroids[among])
    best = found.argmin(axis=1)
    return among[best], as_long(found[np.arange(len(x)), best])


_SUMS = T.StructType(
    [T.StructField("cluster", T.IntegerType()), T.StructField("many", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("total", T.DecimalType(38, 0))]
)


def _block(batch: pa.RecordBatch, row: int, length: int) -> np.ndarray:
    return unpacked(batch.column("x")[row].as_py(), batch.column("width")[row].as_py(), length)


def _box(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(n)[row].values.to_numpy(zero_copy_only=False) for n in ("low", "high"))


def _sums(zones: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of each non-empty cluster."""
    k, length = centroids.shape

    def run(batches):
        counts, totals = [0] * k, [[0] * length for _ in range(k)]
        for batch in batches:
            for row in range(batch.num_rows):
                x, among = _block(batch, row, length), candidate_centroids(*_box(batch, row), centroids)
                cluster = nearest(x, centroids, among)[0] if len(among) > 1 else np.full(len(x), among[0])
                wide = np.int64 if largest(x) * max(1, len(x)) <= LONG else object
                for j in among.tolist():
                    own = x[cluster == j]
                    if len(own):
                        counts[j] += len(own)
                        totals[j] = [a + int(b) for a, b in zip(totals[j], own.astype(wide).sum(axis=0))]
        rows = [(j, counts[j], at, total) for j in range(k) if counts[j] for at, total in enumerate(totals[j])]
        if rows:
            cluster, many, at, total = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cluster, pa.int32()), pa.array(many, pa.int64()), pa.array(at, pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))],
                names=_SUMS.names,
            )

    added = map_batches(zones.select("x", "width", "low", "high"), run, _SUMS).groupBy("cluster", "at").agg(F.sum("many").alias("many"), F.sum("total").alias("total"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in added.orderBy("cluster", "at").collect():
        out.setdefault(r["cluster"], (r["many"], []))[1].append(int(r["total"]))
    return out


_FOUND = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])


def _assigned(zones: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                x = _block(batch, row, centroids.shape[1])
                cluster, distance = nearest(x, centroids, candidate_centroids(*_box(batch, row), centroids))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[row].values, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=_FOUND.names)

    return map_batches(zones, run, _FOUND)


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` rows with the least SHA-256 of "seed:id", in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "vec_id", "x").limit(k).select("x").collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


def cluster(
    rows: DataFrame, k: int = K, rounds: int = ROUNDS, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
    length: int = LENGTH, seed: int = SEED, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Each round assigns all vectors and moves every non-empty centroid to the
    floor of its vectors' mean; rounds end early only where nothing moves, as
    all later ones would give the same.
    """
    stored = materialise(whole_vectors(rows, vector, vec_id, scale, length=length), "zones-vectors")
    ends = stored.agg(F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high")).first()
    centroids = first_centroids(stored, k, seed)
    if not len(centroids):
        schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return rows.sparkSession.createDataFrame([], schema)
    zones = materialise(blocks(along_curve(stored, length, ends.low, ends.high), length, block_rows, zones=True), "zones-blocks")
    discard(stored)
    for _ in range(rounds):
        moved = centroids.copy()
        for j, (many, total) in _sums(zones, centroids).items():
            moved[j] = [t // many for t in total]
        if (moved == centroids).all():
            break
        centroids = moved
    found = materialise(_assigned(zones, centroids), "zones-assigned")
    discard(zones)
    inertia = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    number = lambda v: F.lit(min(v, LONG)).cast("long")
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_cluster = lambda values: F.array(*values)[F.col("cluster")]
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        by_cluster([number(inertia.get(j, 0)) for j in range(len(centroids))]).alias("cluster_inertia"),
        number(sum(inertia.values())).alias("inertia"),
        by_cluster([F.lit(n) for n in names]).alias("centroid_sha256"),
    )
