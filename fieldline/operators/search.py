"""Which features tell two rows apart: greedy removal by cosine similarity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldline import fixed
from fieldline.functions.vectors import cosine

MAX_DROPS = 10


def matched_pairs(
    features: DataFrame, by: Sequence[str], side: str, left, right, names: Sequence[str] = tuple(fixed.PLAY_FEATURES)
) -> DataFrame:
    """Pair the ``left`` row with the ``right`` row of ``side`` that share ``by``.

    ``by`` and ``side`` together identify a row, so each key gives one pair and
    the pairs are found by one grouping, without a join. A second row on either
    side of a key is an error, not a choice between the two.
    """
    vector = F.expr("array(" + ", ".join(f"CAST(`{n}` AS DOUBLE)" for n in names) + ")")

    def of(value) -> Column:
        return F.max(F.when(F.col(side) == value, vector))

    return (
        features.filter(F.col(side).isin(left, right))
        .groupBy(*by)
        .agg(of(left).alias("a"), of(right).alias("b"), *[F.count_if(F.col(side) == v).alias(n) for v, n in ((left, "_n"), (right, "_m"))])
        .filter((F.col("_n") > 0) & (F.col("_m") > 0))
        .filter(F.when((F.col("_n") == 1) & (F.col("_m") == 1), True).otherwise(F.raise_error(F.lit("two rows for one side of a pair"))))
        .drop("_n", "_m")
    )


def pair_cosine(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("cosine", cosine(F.col("a"), F.col("b")))


def _scores(ab: np.ndarray, aa: np.ndarray, bb: np.ndarray) -> np.ndarray:
    """Cosines to 12 decimals: noise of the last digits must not pick a feature.

    Without length there is no cosine, and such a score never wins.
    """
    size = np.sqrt(aa * bb)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(size > 0, np.round(ab / size, 12), -np.inf)


def _without_each(parts: np.ndarray) -> np.ndarray:
    """Row sums without each entry: what comes before plus what comes after.

    Subtracting the entry from the total would lose digits when it is large.
    """
    empty = np.zeros((len(parts), 1))
    before = np.cumsum(np.hstack([empty, parts[:, :-1]]), axis=1)
    after = np.cumsum(np.hstack([empty, parts[:, :0:-1]]), axis=1)[:, ::-1]
    return before + after


def greedy_drops(a: np.ndarray, b: np.ndarray, max_drops: int) -> list[list[int]]:
    """Positions removed from each row of a batch, in order of removal.

    Each round removes the feature whose absence raises the cosine most, if
    any does. Equal scores go to the earlier feature; one that is 0 in both
    rows is never a gain.
    """
    products = [a * b, a * a, b * b]
    kept = np.ones(a.shape, dtype=bool)
    drops = [[] for _ in range(len(a))]
    for _ in range(max_drops):
        parts = [np.where(kept, p, 0.0) for p in products]
        now = _scores(*[p.sum(axis=1) for p in parts])
        scores = np.where(kept, _scores(*[_without_each(p) for p in parts]), -np.inf)
        place = scores.argmax(axis=1)
        gains = np.flatnonzero((scores[np.arange(len(a)), place] > now) & (now > -np.inf))
        if not len(gains):
            break
        kept[gains, place[gains]] = False
        for row in gains:
            drops[row].append(place[row])
    return drops


def dropped_features(
    pairs: DataFrame, names: Sequence[str] = tuple(fixed.PLAY_FEATURES), max_drops: int = MAX_DROPS
) -> DataFrame:
    """Names removed from each pair, in order of removal, at most ``max_drops``.

    A missing number counts as 0, as in ``impute``. A row-wise step on Arrow batches: all rounds run where the pair is, with no
    shuffle between them. (Nested array functions can say the same, but took
    over ten times as long per pair.)
    """
    labels = list(names)

    @F.pandas_udf("array<string>")
    def remove(a: pd.Series, b: pd.Series) -> pd.Series:
        if a.empty:
            return pd.Series([], dtype=object)
        sides = [np.nan_to_num(np.stack([np.asarray(v, dtype=float) for v in x]), nan=0.0) for x in (a, b)]
        drops = greedy_drops(*sides, max_drops)
        return pd.Series([[labels[i] for i in row] for row in drops], dtype=object)

    return pairs.withColumn("dropped", remove("a", "b")).drop("a", "b")


def drop_counts(dropped: DataFrame, keys: Sequence[str] = (), places: bool = False) -> DataFrame:
    """How many pairs removed each feature, at each ``place`` in the order of removal if asked."""
    removed = dropped.select(*keys, F.posexplode("dropped").alias("place", "feature"))
    return removed.groupBy(*keys, *(["place"] if places else []), "feature").agg(F.count("*").alias("n"))
