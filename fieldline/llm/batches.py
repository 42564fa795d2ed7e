"""Small helpers for functions that run on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 2_000
BATCH_BYTES = 32 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small: at most BATCH_ROWS rows and about BATCH_BYTES bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each string."""
    return column.cast(pa.binary()).to_pylist()


def gathered(batches: Iterable[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Join consecutive batches into ones of about ``most_bytes`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 40)[0]
            held, size = [], 0
    if held:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 40)
        yield from whole[:1]


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores in front until it clashes with no column."""
    used = {x.lower() for x in taken}
    while wanted.lower() in used:
        wanted = f"_{wanted}"
    return wanted
