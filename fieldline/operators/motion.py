"""Where and how a player moves in one period: centroid, path, pace, angle.

Sums, means and counts are ordinary aggregates with a partial step, so a hot
group is combined before it is shuffled. Two measures need every row beside its
group: the distance to the group's centroid and the path along the order of
events. Ordinary groups get both from one shuffle with windows. Groups too
large for one task are taken out (see ``skew.split_hot``): their centroids are
broadcast, and their path is cut into ranges of the event order whose ends are
joined up afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldline import fixed
from fieldline.functions import events as ev
from fieldline.operators.skew import HOT_ROWS, split_hot
from fieldline.schema import GROUP

ORDER = ["eventSec", "id"]


def elapsed_measure() -> Column:
    """Sum of the gaps between sorted times, which is last minus first."""
    return F.max("eventSec") - F.min("eventSec")


def event_rate_measure() -> Column:
    return F.try_divide(elapsed_measure(), F.count_distinct("id"))


def angle_measures() -> list[Column]:
    return [F.avg("angle").alias("angle_mean"), F.stddev_samp("angle").alias("angle_std")]


def cell_measures() -> list[Column]:
    """25 cell counts, named by their cell, 0 where nothing happened."""
    return [F.expr(f"count_if(numero_cella_x = {c[0]} AND numero_cella_y = {c[1]}) AS `{c}`") for c in fixed.CELLS]


def elapsed_time(events: DataFrame, keys: Sequence[str] = tuple(GROUP)) -> DataFrame:
    return events.filter(ev.all_present(keys)).groupBy(*keys).agg(elapsed_measure().alias("elapsed"))


def event_rate(events: DataFrame, keys: Sequence[str] = tuple(GROUP)) -> DataFrame:
    """Elapsed time over the number of distinct events."""
    return events.filter(ev.all_present(keys)).groupBy(*keys).agg(event_rate_measure().alias("tempo_medio_tra_eventi"))


def angle_stats(events: DataFrame, keys: Sequence[str] = tuple(GROUP)) -> DataFrame:
    return events.filter(ev.all_present(keys)).groupBy(*keys).agg(*angle_measures())


def previous_event(
    events: DataFrame,
    keys: Sequence[str] = tuple(GROUP),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Each event beside the time of the one before it in its group."""
    order = Window.partitionBy(*keys).orderBy(*ORDER)
    ordinary, hot = split_hot(events, keys, hot_rows)
    plain = ordinary.withColumn("previous_sec", F.lag("eventSec").over(order))
    return plain.unionByName(_previous_in_hot(hot, keys))


def _in_ranges(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in ranges of (group, event order), numbered in ``_piece``.

    Range bounds follow the data down to the event id, so even a group with
    one single time is divided.
    """
    order = [*keys, *ORDER]
    return rows.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id())


def _previous_in_hot(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Look back within each range; the first row of a range takes the last
    time of the range before it. Those first rows are one per range."""
    inner = Window.partitionBy(*keys, "_piece")
    order = inner.orderBy(*ORDER)
    pieces = _in_ranges(rows, keys).withColumns(
        {
            "_back": F.lag("eventSec").over(order),
            "_place": F.when(F.row_number().over(order) == 1, F.lit(-1)).otherwise(F.col("_piece")),
            "_end": F.max("eventSec").over(inner),
        }
    )
    firsts = Window.partitionBy(*keys, "_place").orderBy("_piece")
    found = F.when(F.col("_place") == -1, F.lag("_end").over(firsts)).otherwise(F.col("_back"))
    return pieces.withColumn("previous_sec", found).drop("_piece", "_back", "_place", "_end")


def _own_centroid(keys: Sequence[str]) -> dict[str, Column]:
    group = Window.partitionBy(*keys)
    return {"_cx": F.avg("x").over(group), "_cy": F.avg("y").over(group)}


def _steps(keys: Sequence[str]) -> Column:
    order = Window.partitionBy(*keys).orderBy(*ORDER)
    return ev.point_distance(F.lag("x").over(order), F.lag("y").over(order), F.col("x"), F.col("y"))


def _plain_measures() -> list[Column]:
    return [
        F.avg("x").alias("posizione_media_x"),
        F.avg("y").alias("posizione_media_y"),
        elapsed_measure().alias("_elapsed"),
        *angle_measures(),
        *cell_measures(),
    ]


def _with_rate(measures: DataFrame) -> DataFrame:
    """Rate from elapsed time and distinct events (``_ids``).

    Distinct events are counted apart from the other measures: in one
    aggregate, every event would carry the state of all of them.
    """
    rate = F.try_divide(F.col("_elapsed"), F.col("_ids"))
    return measures.withColumn("tempo_medio_tra_eventi", rate).drop("_elapsed", "_ids")


def _spread_measure() -> Column:
    """Mean distance to the centroid, published as 'standard_deviation'."""
    return F.avg(ev.point_distance(F.col("_cx"), F.col("_cy"), F.col("x"), F.col("y"))).alias("standard_deviation")


def _ordinary_groups(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    last_id = F.lag("id").over(Window.partitionBy(*keys).orderBy("id"))
    beside = rows.withColumns({**_own_centroid(keys), "_step": _steps(keys), "_last_id": last_id})
    measures = beside.groupBy(*keys).agg(
        *_plain_measures(),
        _spread_measure(),
        F.coalesce(F.sum("_step"), F.lit(0.0)).alias("total_distance"),
        F.expr("count_if(id IS NOT NULL AND NOT id <=> _last_id)").alias("_ids"),
    )
    return _with_rate(measures)


def _hot_spread(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    centroids = rows.groupBy(*keys).agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    return rows.join(F.broadcast(centroids), list(keys)).groupBy(*keys).agg(_spread_measure())


def _hot_path(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Path length of hot groups over ranges of their event order.

    Each range adds its own steps; the step from one range to the next is
    added from their ends.
    """
    pieces = _in_ranges(rows.select(*keys, *ORDER, "x", "y"), keys)
    inner = [*keys, "_piece"]
    at, point = F.struct(*ORDER), F.struct("x", "y")
    ends = (
        pieces.withColumn("_step", _steps(inner))
        .groupBy(*inner)
        .agg(
            F.sum("_step").alias("_inside"),
            F.min_by(point, at).alias("_first"),
            F.max_by(point, at).alias("_last"),
        )
    )
    before = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_piece"))
    bridge = ev.point_distance(F.col("_before.x"), F.col("_before.y"), F.col("_first.x"), F.col("_first.y"))
    return (
        ends.withColumn("_before", before)
        .groupBy(*keys)
        .agg(
            (F.coalesce(F.sum("_inside"), F.lit(0.0)) + F.coalesce(F.sum(bridge), F.lit(0.0))).alias("total_distance")
        )
    )


def _hot_groups(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    ids = rows.select(*keys, "id").distinct().groupBy(*keys).agg(F.count("id").alias("_ids"))
    plain = _with_rate(rows.groupBy(*keys).agg(*_plain_measures()).join(ids, list(keys)))
    return plain.join(_hot_spread(rows, keys), list(keys)).join(_hot_path(rows, keys), list(keys))


def group_measures(
    events: DataFrame,
    keys: Sequence[str] = tuple(GROUP),
    hot_rows: int = HOT_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Centroid, spread, pace, angles, path and cells, one row per group.

    ``sizes`` may give rows per key (``_rows``) when they are already known.
    """
    rows = events.select(
        *keys, *ORDER, "x", "y", "angle", "numero_cella_x", "numero_cella_y"
    )
    ordinary, hot = split_hot(rows, keys, hot_rows, sizes)
    return _ordinary_groups(ordinary, keys).unionByName(_hot_groups(hot, keys))


def position_dispersion(events: DataFrame, keys: Sequence[str] = tuple(GROUP), **skew) -> DataFrame:
    """Mean x, mean y and mean distance to that point."""
    return group_measures(events, keys, **skew).select(
        *keys, "posizione_media_x", "posizione_media_y", "standard_deviation"
    )


def total_distance(events: DataFrame, keys: Sequence[str] = tuple(GROUP), **skew) -> DataFrame:
    """Length of the way from event to event; 0 for a single event."""
    return group_measures(events, keys, **skew).select(*keys, "total_distance")
