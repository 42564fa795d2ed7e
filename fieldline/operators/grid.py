"""5x5 pitch grids per team: frequencies, similarity, dominance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldline import fixed
from fieldline.functions import events as ev
from fieldline.schema import CELL
from fieldline.session import materialise

TEAM_CELL = ["teamId", *CELL]
COUNTS = ["n_events", "n_accurate_pass", "n_shot", "n_foul"]


def _is_accurate_pass() -> Column:
    return (F.col("eventId") == fixed.PASS) & ev.has_tag(fixed.TAG_ACCURATE)


def _is_shot() -> Column:
    return F.col("eventId") == fixed.SHOT


def _is_foul() -> Column:
    return (F.col("eventId") == fixed.FOUL) & (F.col("subEventId") == fixed.SUB_FOUL)


def cell_activity(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of events, accurate passes, shots and fouls per key.

    Cells are never NULL, so only the other keys are checked.
    """
    return (
        events.filter(ev.all_present([k for k in keys if k not in CELL]))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n_events"),
            F.count_if(_is_accurate_pass()).alias("n_accurate_pass"),
            F.count_if(_is_shot()).alias("n_shot"),
            F.count_if(_is_foul()).alias("n_foul"),
        )
    )


def with_opponent(activity: DataFrame) -> DataFrame:
    """Add the other team of the match; a match must have two teams.

    ``activity`` has at most 25 rows per team and match, so the window over a
    match sees at most 50.
    """
    match = Window.partitionBy("matchId")
    low, high = F.min("teamId").over(match), F.max("teamId").over(match)
    marked = activity.withColumns({"_low": low, "_high": high})
    two = (F.col("_low") != F.col("_high")) & F.col("teamId").isin(F.col("_low"), F.col("_high"))
    other = F.when(F.col("teamId") == F.col("_low"), F.col("_high")).otherwise(F.col("_low"))
    return marked.withColumn(
        "opponent",
        F.when(two, other).otherwise(F.raise_error(F.lit("a match without exactly two teams"))),
    ).drop("_low", "_high")


def suffered_fouls(activity: DataFrame) -> DataFrame:
    """Fouls from the side of the fouled team: other team, mirrored cell."""
    return with_opponent(activity).filter(F.col("n_foul") > 0).select(
        F.col("opponent").alias("teamId"),
        *[ev.mirror_cell(F.col(c)).alias(c) for c in CELL],
        "n_foul",
    )


def grid_frequencies(events: DataFrame) -> DataFrame:
    """Share of a team's events, accurate passes, shots and suffered fouls
    that fall into each cell, for the cells in which the team had an event.

    Everything is counted per match, team and cell first; what follows works
    on at most 25 rows per team and match. Each of them counts once for its own
    team and once, mirrored, for the fouled one.
    """
    per_match = cell_activity(events, ["matchId", *TEAM_CELL])
    none = F.lit(0).cast("bigint")
    own = F.struct(*TEAM_CELL, *COUNTS[:3], none.alias("n_foul"))
    suffered = F.struct(
        F.col("opponent").alias("teamId"),
        *[ev.mirror_cell(F.col(c)).alias(c) for c in CELL],
        *[none.alias(c) for c in COUNTS[:3]],
        "n_foul",
    )
    sides = with_opponent(per_match).select(F.inline(F.array(own, suffered)))
    cells = sides.groupBy(*TEAM_CELL).agg(*[F.sum(c).alias(c) for c in COUNTS])
    team = Window.partitionBy("teamId")
    shares = [
        F.coalesce(F.try_divide(F.col(c), F.sum(c).over(team)), F.lit(0.0)).alias(name)
        for c, name in zip(COUNTS, fixed.GRID_METRICS)
    ]
    return (
        cells.select("*", *shares)
        .filter(F.col("n_events") > 0)
        .select(F.col("teamId").alias("nome_squadra"), *CELL, *fixed.GRID_METRICS)
    )


def grid_matrix(grid: DataFrame, metrics: Sequence[str] = tuple(fixed.GRID_METRICS)) -> DataFrame:
    """Team's grids with one row per metric (numbered from 1) and cell y, and one column per cell x."""
    entries = [F.struct(F.lit(i + 1).alias("tipo_griglia"), F.col(m).alias("_value")) for i, m in enumerate(metrics)]
    long = grid.select("nome_squadra", *CELL, F.inline(F.array(*entries)))
    columns = [F.avg(F.when(F.col(CELL[0]) == i, F.col("_value"))).alias(f"x{i}") for i in range(fixed.GRID_SIDE)]
    return long.groupBy("nome_squadra", "tipo_griglia", CELL[1]).agg(*columns)


def _side_by_side(grid: DataFrame, team_a, team_b) -> DataFrame:
    """One row per cell with each metric of both teams; NULL where absent."""
    sides = []
    for metric in fixed.GRID_METRICS:
        for side, team in (("a", team_a), ("b", team_b)):
            sides.append(F.max(F.when(F.col("nome_squadra") == team, F.col(metric))).alias(f"{metric}_{side}"))
    return grid.filter(F.col("nome_squadra").isin(team_a, team_b)).groupBy(*CELL).agg(*sides)


def _long_metrics(sides: DataFrame) -> DataFrame:
    """One row per cell and metric, numbered from 1."""
    entries = [
        F.struct(
            F.lit(i + 1).alias("tipo_griglia"), F.col(f"{m}_a").alias("a"), F.col(f"{m}_b").alias("b")
        )
        for i, m in enumerate(fixed.GRID_METRICS)
    ]
    return sides.select(*CELL, F.inline(F.array(*entries)))


def grid_similarity(grid: DataFrame, team_a, team_b) -> DataFrame:
    """Cosine of the two teams' grids, one row per metric; absent cells are 0."""
    cells = _long_metrics(_side_by_side(grid, team_a, team_b).na.fill(0.0))
    return cells.groupBy("tipo_griglia").agg(
        F.try_divide(
            F.sum(F.col("a") * F.col("b")),
            F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b"))),
        ).alias("similarity")
    )


def grid_dominance(grid: DataFrame, team_a, team_b, tie: str | None = None) -> DataFrame:
    """Which team leads in each cell that both have, by how much, per metric."""
    cells = _long_metrics(
        _side_by_side(grid, team_a, team_b).filter(
            F.col("frequenza_eventi_a").isNotNull() & F.col("frequenza_eventi_b").isNotNull()
        )
    )
    leader = ev.dominant(
        F.col("a"), F.col("b"), F.lit(team_a), F.lit(team_b), None if tie is None else F.lit(tie)
    )
    return cells.select(
        *CELL,
        F.abs(F.col("a") - F.col("b")).alias("differenza_di_frequenza"),
        leader.alias("squadra_dominante"),
        "tipo_griglia",
    )


def side_activity(events: DataFrame, home: DataFrame) -> DataFrame:
    """``cell_activity`` per match and team with sides normalised.

    Events are counted by their cell as recorded and as turned round; which of
    the two holds is settled for the counts, so the log does not meet the
    matches.
    """
    turned = {f"_{c}": ev.grid_cell(F.lit(100.0) - F.col(axis)) for c, axis in zip(CELL, ("x", "y"))}
    counts = cell_activity(events.withColumns(turned), ["matchId", "matchPeriod", *TEAM_CELL, *turned])
    joined = counts.join(home, "matchId", "left")
    cell = {
        c: ev.attack_left_to_right(F.col(c), F.col("teamId"), F.col("home_team"), F.col("matchPeriod"), F.col(f"_{c}"))
        for c in CELL
    }
    return joined.withColumns(cell).groupBy("matchId", *TEAM_CELL).agg(*[F.sum(c).alias(c) for c in COUNTS])


def match_grid_frequencies(events: DataFrame, home: DataFrame | None = None) -> DataFrame:
    """Season cell counts of a team over its totals in each match.

    One row per match, team and cell the team used in the season. Cells of a
    team (25 at most) travel as one array to the team's matches. The counts per
    match and cell are written out, so the events are read once. With ``home``
    (matchId, home_team) sides are normalised.
    """
    counts = cell_activity(events, ["matchId", *TEAM_CELL]) if home is None else side_activity(events, home)
    per_match = materialise(counts, "match-cells")
    sums = [F.sum(c).alias(c) for c in COUNTS[:3]]
    totals = per_match.groupBy("matchId", "teamId").agg(*sums)
    season = (
        per_match.groupBy(*TEAM_CELL)
        .agg(*[F.sum(c).alias(f"cell_{c}") for c in COUNTS[:3]])
        .groupBy("teamId")
        .agg(F.collect_list(F.struct(*CELL, *[f"cell_{c}" for c in COUNTS[:3]])).alias("cells"))
    )
    rows = totals.join(season, "teamId").select("*", F.inline("cells"))
    shares = [
        F.coalesce(F.try_divide(F.col(f"cell_{c}"), F.col(c)), F.lit(0.0)).alias(name)
        for c, name in zip(COUNTS[:3], ["events_freq", "acc_pass_freq", "shot_freq"])
    ]
    return rows.select("matchId", "teamId", *CELL, *shares)


def home_teams(matches: DataFrame, teams: DataFrame) -> DataFrame:
    """Home team id of each match, found by the first word of its label."""
    named = matches.select(
        F.col("wyId").alias("matchId"), ev.home_name(F.col("label")).alias("name")
    )
    ids = teams.select("name", F.col("wyId").alias("home_team"))
    return named.join(ids, "name", "left").select("matchId", "home_team")


def normalise_sides(events: DataFrame, home: DataFrame) -> DataFrame:
    """Turn coordinates so that sides agree over halves, and redo the cells.

    The matches, one row each, are broadcast where their size allows it, else
    adaptive execution splits a match with very many events.
    """
    joined = events.join(home, "matchId", "left")
    turned = {
        c: ev.attack_left_to_right(F.col(c), F.col("teamId"), F.col("home_team"), F.col("matchPeriod"))
        for c in ("x", "y")
    }
    return (
        joined.withColumns(turned)
        .withColumns({c: ev.grid_cell(F.col(axis)) for c, axis in zip(CELL, ("x", "y"))})
        .drop("home_team")
    )
