"""Cell counts as 25 columns, and shares of the cells of a match period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldline import fixed
from fieldline.functions import events as ev
from fieldline.operators.motion import cell_measures
from fieldline.schema import GROUP, NO_PLAYER, PERIOD


def without_no_player(events: DataFrame) -> DataFrame:
    return events.filter(F.col("playerId") != NO_PLAYER)


def cell_counts(events: DataFrame, keys: Sequence[str] = tuple(GROUP)) -> DataFrame:
    """Events per cell and key; the fixed cell list needs no look at the data."""
    return events.filter(ev.all_present(keys)).groupBy(*keys).agg(*cell_measures())


def cell_shares(events: DataFrame) -> DataFrame:
    """Player's events in a cell / all events in the cell in that period.

    NULL where nobody had an event in the cell. A window adds up the period's
    players, who are few, after the events have been counted.
    """
    period = Window.partitionBy(*PERIOD)
    return cell_counts(without_no_player(events)).select(
        *GROUP, *[F.try_divide(F.col(c), F.sum(c).over(period)).alias(c) for c in fixed.CELLS]
    )
