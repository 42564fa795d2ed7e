"""Expressions over arrays of doubles and over sets of columns in one row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldline import fixed


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, NULL when either has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def least_kept_sql(cells: Sequence[str] = tuple(fixed.CELLS), keep: int = 3) -> str:
    entries = ", ".join(f"named_struct('v', `{c}`, 'i', {i})" for i, c in enumerate(cells))
    return f"element_at(sort_array(array({entries}), false), {int(keep)})"


def least_kept(cells: Sequence[str] = tuple(fixed.CELLS), keep: int = 3) -> Column:
    """The ``keep``-th largest cell of a row as a struct (v, i).

    Equal counts are decided for the later cell.
    """
    return F.expr(least_kept_sql(cells, keep))


def cells_from_sql(least: str, cells: Sequence[str] = tuple(fixed.CELLS)) -> list[str]:
    return [
        f"CASE WHEN `{c}` > {least}.v OR (`{c}` = {least}.v AND {i} >= {least}.i) THEN `{c}` ELSE 0D END AS `{c}`"
        for i, c in enumerate(cells)
    ]


def cells_from(least: str, cells: Sequence[str] = tuple(fixed.CELLS)) -> list[Column]:
    """The cells that rank at or above the struct ``least``; the others become 0."""
    return [F.expr(c) for c in cells_from_sql(least, cells)]


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each centre."""
    found = np.empty((len(points), len(centres)))
    for i, c in enumerate(centres):
        away = points - c
        np.einsum("ij,ij->i", away, away, out=found[:, i])
    return found


def nearest_index(found: np.ndarray) -> np.ndarray:
    """Index of the least distance per row, compared to 9 decimals so that noise does not choose; ties take the lower index."""
    return np.round(found, 9).argmin(axis=1)


def nearest(point: Column, centres: Sequence[Sequence[float]]) -> Column:
    """Struct (d, i): squared distance to the nearest centre and its index.

    Equal distances are decided for the lower index. Runs on Arrow batches, so
    that a batch is a few matrix operations and centres are not part of the
    query's text.
    """
    table = np.array(centres, dtype=float)

    @F.pandas_udf("struct<d: double, i: int>")
    def find(points: pd.Series) -> pd.DataFrame:
        found = distances(np.stack(points.to_numpy()), table) if len(points) else np.zeros((0, len(table)))
        return pd.DataFrame({"d": found.min(axis=1), "i": nearest_index(found).astype(np.int32)})

    return find(point)


def pick_label(index: Column, labels: Sequence[str]) -> Column:
    """Label of a cluster index counted from 0."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), index + 1)
