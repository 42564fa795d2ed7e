"""Exact quantiles of any measure, per group, without a task that holds all its values.

Equal values of a group are merged first, with a partial step, so a value that
a third of the rows share is one row. What is left is cut into ranges of
(group, value); the totals of the ranges tell which of them hold the wanted
ranks, and only those ranges are ordered, each in a task of its own. A group
may span any number of ranges and a range any number of groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldline.session import materialise


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Equality of ``names`` (in ``right`` with an underscore in front), null counting as a group."""
    match = F.lit(True)
    for c in names:
        match &= left[c].eqNullSafe(right[f"_{c}"])
    return match


def ranged_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values per group (``_value``) with their count (``_n``) and the number of their range (``_piece``); stored.

    Ranges ascend with (group, value). Null and undefined values are left out.
    """
    merged = (
        df.select(*by, F.col(value).cast("double").alias("_value")).filter("_value IS NOT NULL AND NOT isnan(_value)")
        .groupBy(*by, "_value").agg(F.count("*").alias("_n"))
    )
    return materialise(merged.repartitionByRange(*by, "_value").withColumn("_piece", F.spark_partition_id()), "quantile-ranges")


def quantiles(df: DataFrame, value: str, q: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles of ``value`` per group, interpolated between neighbours: by, q, n (values), value.

    One row per group and entry of ``q``; null counts as a group, a group
    without any value gives no row. A value is found by its rank, so the result
    does not depend on how the rows are partitioned.
    """
    if wrong := [x for x in q if not 0 <= x <= 1]:
        raise ValueError(f"not between 0 and 1: {wrong}")
    by = list(by)
    stored = ranged_counts(df, value, by)
    order = Window.partitionBy(*by).orderBy("_piece")
    totals = stored.groupBy(*by, "_piece").agg(F.sum("_n").alias("_in")).withColumns(
        {
            "_before": F.sum("_in").over(order) - F.col("_in"),
            "_all": F.sum("_in").over(Window.partitionBy(*by)),
        }
    )
    # The two ranks (from 0) that a quantile lies between; one row per range that holds either.
    wanted = F.explode(F.array(*[F.lit(float(x)) for x in q])).alias("_q")
    ranks = totals.select("*", wanted).withColumn("_at", F.col("_q") * (F.col("_all") - 1))
    ranks = ranks.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
    ranks = ranks.filter("_rank >= _before AND _rank < _before + _in")
    needed = ranks.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_piece").alias("_in_piece"), "_before").distinct()
    inside = Window.partitionBy(*by, "_piece").orderBy("_value")
    held = stored.join(needed, _same(stored, needed, by) & (stored["_piece"] == needed["_in_piece"]), "left_semi")
    placed = held.withColumn("_upto", F.sum("_n").over(inside)).withColumn("_from", F.col("_upto") - F.col("_n"))
    asked = ranks.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_piece").alias("_in_piece"), "_before", "_all", "_q", "_at", "_rank")
    place = F.col("_rank") - F.col("_before")
    found = placed.join(
        asked, _same(placed, asked, by) & (placed["_piece"] == asked["_in_piece"]) & (place >= F.col("_from")) & (place < F.col("_upto"))
    )
    low, high = F.min_by("_value", "_rank"), F.max_by("_value", "_rank")
    share = F.max(F.col("_at") - F.floor("_at"))
    return found.groupBy(*by, F.col("_q").alias("q")).agg(
        F.max("_all").alias("n"), (low + (high - low) * share).alias(value)
    )


def above_quantile(df: DataFrame, value: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    """Rows strictly above their group's quantile of ``value``."""
    limits = quantiles(df, value, [q], by).select(*[F.col(c).alias(f"_{c}") for c in by], F.col(value).alias("_limit"))
    match = _same(df, limits, by) & (df[value] > limits["_limit"])
    return df.join(limits, match, "left_semi")
