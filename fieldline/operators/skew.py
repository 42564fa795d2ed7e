"""Ways to keep a key that holds much of the data from ending in one task.

Joins with a table of one row per key are plain joins: adaptive execution
splits a hot key's rows by their measured size and leaves the rest alone. Only
windows, which need a group's rows in one place, are treated here.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldline.functions.events import all_present

# A key with more rows than this does not go to a single task. So there is one such key at most for as many rows, and
# a list of them (a key of some 40 bytes for two million rows) may be broadcast.
HOT_ROWS = 2_000_000


class Split(NamedTuple):
    """Rows of ordinary keys and rows of hot keys; together all rows with a key."""

    ordinary: DataFrame
    hot: DataFrame


def key_sizes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.filter(all_present(keys)).groupBy(*keys).agg(F.count("*").alias("_rows"))


def split_hot(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, sizes: DataFrame | None = None) -> Split:
    """Take out every key with more than ``hot_rows`` rows, however many there are.

    Nothing runs while the plan is made: the list of hot keys is part of it, and
    adaptive execution leaves out the branch of hot keys once the list turns out
    empty.
    """
    present = rows.filter(all_present(keys))
    sizes = key_sizes(rows, keys) if sizes is None else sizes
    listed = F.broadcast(sizes.filter(F.col("_rows") > hot_rows).select(*keys))
    return Split(*(present.join(listed, list(keys), how).select(*rows.columns) for how in ("left_anti", "left_semi")))
