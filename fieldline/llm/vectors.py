"""Vectors as whole numbers: reading them, packing rows into blocks, and exact products of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldline.llm.batches import gathered, list_array, map_batches

# Scaled components beyond this count as this; doubles hold every whole number up to it.
MOST = 1 << 52
LONG = (1 << 63) - 1


def whole_vectors(rows: DataFrame, vector: str, row_id: str, scale: int, shift: int = 0, length: int | None = None) -> DataFrame:
    """(vec_id, x): x is floor(scale * component) + shift of each vector that has finite components only.

    Null vectors and vectors with a null, infinite or undefined component are
    left out, and where ``length`` is given those of another length.
    """
    own = rows.select(F.col(row_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = F.col("v").isNotNull() & F.coalesce(finite, F.lit(False))
    if length is not None:
        kept &= F.size("v") == length
    bound = F.lit(float(MOST))
    x = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * F.lit(float(scale)), -bound), bound)) + F.lit(shift))
    return own.filter(kept).select("vec_id", x.alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as int64, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def packed(values: np.ndarray) -> tuple[bytes, int]:
    """A block in the narrowest integers that hold it, and their width in bytes."""
    most = max(-int(values.min(initial=0)), int(values.max(initial=0)) + 1)
    width = next(w for w in (1, 2, 4, 8) if most <= 1 << (8 * w - 1))
    return values.astype(f"<i{width}").tobytes(), width


def unpacked(data: bytes, width: int, columns: int) -> np.ndarray:
    values = np.frombuffer(data, dtype=f"<i{width}")
    return values.reshape(-1, columns) if columns else values.reshape(0, 0)


_BLOCK = [
    T.StructField("block", T.LongType()),
    T.StructField("first", T.LongType()),
    T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("x", T.BinaryType()),
    T.StructField("width", T.IntegerType()),
]
BLOCKS = T.StructType(_BLOCK)
ZONES = T.StructType([*_BLOCK, T.StructField("low", T.ArrayType(T.LongType(), False)), T.StructField("high", T.ArrayType(T.LongType(), False))])


def blocks(rows: DataFrame, columns: int, size: int, zones: bool = False) -> DataFrame:
    """``rows`` (vec_id, x) packed in their order: one row for up to ``size`` vectors, with the least and largest of each component if ``zones``.

    The number of a block is that of its task; blocks of one task differ in the place ``first`` of their first row.
    """

    def run(batches):
        number, first = TaskContext.get().partitionId(), 0
        for batch in gathered(batches, size * (8 * columns + 16)):
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                values = matrix(part.column(1), columns)
                data, width = packed(values)
                ids = part.column(0)
                made = [
                    pa.array([number], pa.int64()),
                    pa.array([first], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([data], pa.binary()),
                    pa.array([width], pa.int32()),
                ]
                if zones:
                    made += [list_array(f(values, axis=0), np.array([columns]), pa.int64()) for f in (np.min, np.max)]
                yield pa.RecordBatch.from_arrays(made, names=(ZONES if zones else BLOCKS).names)
                first += len(ids)

    return map_batches(rows.select("vec_id", "x"), run, ZONES if zones else BLOCKS)


def ids_of(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of one block and which of them are null (0 there)."""
    own = column[row].values
    return own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), own.is_null().to_numpy(zero_copy_only=False)


def largest(values: np.ndarray) -> int:
    return max(abs(int(values.min(initial=0))), abs(int(values.max(initial=0))))


def exact_kind(bound: int) -> type:
    """A number type that holds every whole number up to ``bound`` exactly; floats first, for the speed of their products."""
    return next((kind for kind, most in ((np.float32, 1 << 24), (np.float64, 1 << 53), (np.int64, LONG)) if bound <= most), object)


def as_long(values: np.ndarray) -> np.ndarray:
    """int64 values; those beyond LONG on either side count as LONG."""
    if values.dtype == object:
        values = np.clip(values, -LONG, LONG)
    return values.astype(np.int64)
