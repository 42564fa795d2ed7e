"""Running totals over an order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldline.llm.batches import map_batches
from fieldline.session import materialise


def running_total(rows: DataFrame, size: str, order: Sequence[str], by: Sequence[str] = (), into: str = "before") -> DataFrame:
    """``rows`` with the sum of ``size`` over all rows before it in ``order`` (within ``by``).

    The rows are range-partitioned and sorted; each task adds up its own part,
    and the totals of the parts, one row per task and group, are added in
    front. A group may therefore span any number of tasks. Nulls come first and
    count as a group; rows that tie in ``order`` follow one another in any
    order. ``size`` must not be null.
    """
    keys = [*by, *order]
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])
    at, groups = rows.columns.index(size), [rows.columns.index(c) for c in by]

    def run(batches):
        part = TaskContext.get().partitionId()
        last, total = None, 0
        for batch in batches:
            values = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(values):
                continue
            before = np.cumsum(values) - values
            first = np.zeros(len(values), dtype=bool)
            first[0] = True
            for g in groups:
                codes = batch.column(g).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                first[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(first)
            base = -before[starts]
            keys_here = [tuple(batch.column(g)[int(i)].as_py() for g in groups) for i in (starts[0], len(values) - 1)]
            if keys_here[0] == last:
                base[0] += total
            local = before + np.repeat(base, np.diff(np.append(starts, len(values))))
            last, total = keys_here[1], int(local[-1] + values[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(values), part, dtype=np.int32)), pa.array(local)],
                names=[*batch.schema.names, "_part", "_local"],
            )

    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = materialise(map_batches(ordered, run, schema), "running")
    totals = stored.groupBy(*by, "_part").agg(F.sum(size).alias("_sum"))
    window = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_of"), F.coalesce(F.sum("_sum").over(window), F.lit(0)).alias("_base"))
    match = F.col("_part") == F.col("_of")
    for c in by:
        match &= stored[c].eqNullSafe(bases[f"_by_{c}"])
    return stored.join(bases, match).select(*rows.columns, (F.col("_local") + F.col("_base")).alias(into))
