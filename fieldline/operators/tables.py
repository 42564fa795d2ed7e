"""Small table operators: counts of values, top, dedup, sets, assembling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldline.functions.events import all_present
from fieldline.schema import NO_PLAYER


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, most frequent first."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc(column))
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def number_of_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.filter(all_present(keys)).select(*keys).distinct().agg(F.count("*").alias("n_groups"))


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` does not have.

    Both sides are made distinct before they meet, so that a log on either side
    is shuffled after its partial aggregate only.
    """
    return a.distinct().subtract(b.distinct())


def find_player(players: DataFrame, name: str) -> DataFrame:
    """Players whose surname contains a match of the pattern."""
    return players.filter(F.col("lastName").rlike(name))


def rows_of(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


def best_of(df: DataFrame, item: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """The item with the highest score, per key or overall; a tie goes to the
    first item in order."""
    ranked = F.struct((-F.col(score)).alias("_score"), F.col(item))
    picked = df.groupBy(*keys).agg(F.min(ranked).alias("_best"))
    return picked.select(*keys, F.col("_best").getField(item).alias(item))


def with_names(df: DataFrame, names: DataFrame, how: str = "left") -> DataFrame:
    """Attach ``name`` by ``playerId``; the join picks broadcast by size."""
    return df.join(names.select("playerId", "name"), "playerId", how)


def histogram(df: DataFrame, group: str, value: str, bins: Mapping[str, int]) -> DataFrame:
    """Equal-width bins between each group's smallest and largest value.

    The top value belongs to the last bin; empty bins are not listed. There is
    one (broadcast) range per entry of ``bins``.
    """
    wanted = df.filter(F.col(group).isin(list(bins)) & F.col(value).isNotNull())
    counts = F.create_map(*[F.lit(v) for pair in bins.items() for v in pair])
    ranges = (
        wanted.groupBy(group)
        .agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        .withColumn("_bins", counts[F.col(group)])
    )
    width = (F.col("_hi") - F.col("_lo")) / F.col("_bins")
    place = F.floor(F.try_divide(F.col(value) - F.col("_lo"), width))
    binned = wanted.join(F.broadcast(ranges), group).withColumn(
        "bin", F.least(F.coalesce(place, F.lit(0)), F.col("_bins") - 1).cast("int")
    )
    return binned.groupBy(group, "bin").agg(
        F.min(F.col("_lo") + F.col("bin") * width).alias("bin_start"), F.count("*").alias("n")
    )


def merge_measures(tables: Mapping[str, DataFrame] | Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of many tables on the same keys, as one aggregate.

    Each table has one row per key and its own columns. Stacking them and
    grouping once costs one shuffle instead of one per join. A key that occurs
    twice in a table is an error, and so is a column name in two tables.
    """
    parts = list(tables.values()) if isinstance(tables, Mapping) else list(tables)
    names = [c for p in parts for c in p.columns if c not in keys]
    if twice := sorted({c for c in names if names.count(c) > 1}):
        raise ValueError(f"columns in more than one table: {twice}")
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [p.withColumn("_source", F.lit(i)) for i, p in enumerate(parts)],
    ).filter(all_present(keys))
    values = [c for c in stacked.columns if c not in {*keys, "_source"}]
    once = F.count("*") == F.size(F.collect_set("_source"))
    return (
        stacked.groupBy(*keys)
        .agg(*[F.max(c).alias(c) for c in values], once.alias("_once"))
        .filter(F.when(F.col("_once"), True).otherwise(F.raise_error(F.lit("a key occurs twice in a measure table"))))
        .drop("_once")
    )


def pivot_measures(tall: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per key with a column per measure, from rows (keys..., level, name, value) of many tables.

    Only measures with exactly these keys are taken. One aggregate, whatever the
    number of tables; a key that occurs twice for one measure is an error.
    """
    own = tall.filter((F.col("level") == F.array(*[F.lit(k) for k in keys])) & all_present(keys))
    once = F.when(F.count("name") == F.size(F.collect_set("name")), F.map_from_entries(F.collect_list(F.struct("name", "value"))))
    found = own.groupBy(*keys).agg(
        F.coalesce(once, F.raise_error(F.lit("a key occurs twice in a measure table")).cast("map<string,double>")).alias("_measures")
    )
    return found.select(*keys, *[F.col("_measures")[n].alias(n) for n in names])


def assemble_measures(
    by_match: Sequence[DataFrame], by_player: Sequence[DataFrame], match_keys: Sequence[str] = ("matchId", "playerId")
) -> DataFrame:
    """All measures in one table, without the 'no player' id.

    A full outer join on the player, in two parts so that adaptive execution can
    split a player with very many rows: rows with their season, and season-only
    players.
    """
    wide = merge_measures(by_match, match_keys).filter(F.col("playerId") != NO_PLAYER)
    season = merge_measures(by_player, ["playerId"]).filter(F.col("playerId") != NO_PLAYER)
    played = wide.join(season, "playerId", "left")
    only_season = season.join(wide.select("playerId").distinct(), "playerId", "left_anti")
    return played.unionByName(only_season, allowMissingColumns=True)
