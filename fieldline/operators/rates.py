"""Counts and shares of kinds of events: per team, per player, per season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldline import fixed
from fieldline.functions import events as ev
from fieldline.schema import GROUP, TEAM_PERIOD, EventSpec
from fieldline.session import materialise

ALL_EVENTS = "n_all"


def spec_counts(specs: Sequence[EventSpec]) -> list[Column]:
    return [
        F.expr(f"count_if({ev.event_condition(s.event, s.sub_event, s.tag)}) AS {s.count_column}") for s in specs
    ]


def group_counts(events: DataFrame, keys: Sequence[str], specs: Sequence[EventSpec] = ()) -> DataFrame:
    """Events per key, and of each kind: one pass, one partial aggregate."""
    counts = [F.count("*").alias(ALL_EVENTS), *spec_counts(specs)]
    return events.filter(ev.all_present(keys)).groupBy(*keys).agg(*counts)


def player_counts(events: DataFrame, specs: Sequence[EventSpec]) -> DataFrame:
    """Stored counts per match, period, team and player.

    Written out because totals are taken from it as well: the log, far larger,
    is then read once.
    """
    return materialise(group_counts(events, [*TEAM_PERIOD, "playerId"], specs), "player-counts")


def with_team_totals(counts: DataFrame, specs: Sequence[EventSpec]) -> DataFrame:
    """Player counts of a match period beside the totals of the team."""
    totals = counts.groupBy(*TEAM_PERIOD).agg(*[F.expr(f"sum({s.count_column}) AS team_{s.name}") for s in specs])
    return counts.join(totals, TEAM_PERIOD)


def share_of_team(events: DataFrame, spec: EventSpec) -> DataFrame:
    """Player's events of a kind / the team's, per match and period."""
    counts = group_counts(events.filter(ev.matches_spec(spec)), [*TEAM_PERIOD, "playerId"], [spec])
    team = F.sum(spec.count_column).over(Window.partitionBy(*TEAM_PERIOD))  # a team's players: few rows
    return counts.select(*GROUP, "teamId", (F.col(spec.count_column) / team).alias(f"{spec.name}_pct_WRT"))


def share_of_player(events: DataFrame, spec: EventSpec) -> DataFrame:
    """Player's events of a kind / all events of the player in the period."""
    counts = group_counts(events, [*TEAM_PERIOD, "playerId"], [spec]).filter(F.col(spec.count_column) > 0)
    return counts.select(
        *GROUP, "teamId", (F.col(spec.count_column) / F.col(ALL_EVENTS)).alias(f"{spec.name}_pct_WRP")
    )


def shares_from_counts(counts: DataFrame, specs: Sequence[EventSpec] = tuple(fixed.SHARE_SPECS)) -> DataFrame:
    """All shares, one row per match, period and player, from player counts.

    A player listed under both teams of a match (the 'no player' id) gets the
    share of both teams' events together.
    """
    team = [s for s in specs if s.share_of == "team"]
    known = counts.filter(ev.all_present([*TEAM_PERIOD, "playerId"]))
    summed = (
        with_team_totals(known, team)
        .groupBy(*GROUP)
        .agg(
            F.sum(ALL_EVENTS).alias(ALL_EVENTS),
            *[F.expr(f"sum({s.count_column}) AS {s.count_column}") for s in specs],
            *[F.expr(f"sum(team_{s.name}) AS team_{s.name}") for s in team],
        )
    )
    shares = []
    for s in specs:
        whole = f"team_{s.name}" if s.share_of == "team" else ALL_EVENTS
        names = fixed.FOUL_SHARE_NAMES if s.name == "foul" else [s.share_column]
        # a share exists only where the part was seen at all
        shares += [f"CASE WHEN {s.count_column} > 0 THEN {s.count_column} / {whole} END AS {n}" for n in names]
    return summed.selectExpr(*GROUP, *shares)


def event_shares(events: DataFrame, specs: Sequence[EventSpec] = tuple(fixed.SHARE_SPECS)) -> DataFrame:
    """All shares for the players seen in at least one kind of event."""
    shares = shares_from_counts(player_counts(events, specs), specs)
    seen = F.coalesce(*[c for c in shares.columns if c not in GROUP]).isNotNull()
    return shares.filter(seen)


def season_means(events: DataFrame, specs: Sequence[EventSpec] = tuple(fixed.SEASON_SPECS)) -> DataFrame:
    """Events of a kind per match played; NULL for players without any."""
    per_match = (
        events.filter(F.col("playerId").isNotNull()).groupBy("playerId", "matchId").agg(*spec_counts(specs))
    )
    return per_match.groupBy("playerId").agg(*season_measures(specs))


def season_measures(specs: Sequence[EventSpec], matches: Column | None = None) -> list[Column]:
    """Season means over rows that are already one per player and match."""
    matches = F.count("matchId") if matches is None else matches
    out = []
    for s in specs:
        total = F.sum(s.count_column)
        out.append(F.when(total > 0, F.try_divide(total, matches)).alias(s.name))
    return out


LEFT_FOOT = EventSpec("left", tag=fixed.TAG_LEFT)
RIGHT_FOOT = EventSpec("right", tag=fixed.TAG_RIGHT)
FOOT_SPECS = [LEFT_FOOT, RIGHT_FOOT]


def foot_balance_measure(left: Column, right: Column) -> Column:
    """|left - right| / (left + right), NULL for neither."""
    return F.try_divide(F.abs(left - right), left + right)


def foot_balance(events: DataFrame) -> DataFrame:
    """0 for players who use both feet alike, 1 for one foot only."""
    counts = group_counts(events, ["playerId"], FOOT_SPECS)
    return counts.select(
        "playerId", foot_balance_measure(F.col("n_left"), F.col("n_right")).alias("ambidestro")
    ).filter(F.col("ambidestro").isNotNull())


def two_position_share(events: DataFrame) -> DataFrame:
    """Percentage of events with a start and an end, by event name."""
    return (
        events.filter(F.col("eventName").isNotNull())
        .groupBy("eventName")
        .agg((F.count_if("has_doublepos") * 100 / F.count("id")).alias("two_position_pct"))
    )


PASSES = EventSpec("total_pass", event=fixed.PASS)
ACCURATE_PASSES = EventSpec("accurate_pass", event=fixed.PASS, tag=fixed.TAG_ACCURATE)


def pass_accuracy_by_player(events: DataFrame) -> DataFrame:
    """Accurate passes / passes, for players with at least one accurate pass."""
    counts = (
        events.filter((F.col("eventId") == fixed.PASS) & ev.all_present(["playerId", "teamId"]))
        .groupBy("playerId", "teamId")
        .agg(F.count("*").alias("total_pass"), F.count_if(ev.has_tag(fixed.TAG_ACCURATE)).alias("accurate_pass"))
    )
    return counts.filter(F.col("accurate_pass") > 0).withColumn(
        "accuracy", F.col("accurate_pass") / F.col("total_pass")
    )


def tackles_by_player(events: DataFrame) -> DataFrame:
    """Tackles and won tackles per player."""
    return (
        events.filter((F.col("subEventId") == fixed.SUB_TACKLE) & F.col("playerId").isNotNull())
        .groupBy("playerId")
        .agg(F.count("*").alias("n_tackles"), F.count_if(ev.has_tag(fixed.TAG_TACKLE_WON)).alias("n_tackles_won"))
    )


def count_quantile(counts: DataFrame, column: str, q: float) -> Column:
    """Exact interpolated quantile of a column of positive counts, as a scalar.

    Equal counts are merged first: distinct positive counts that add up to n
    events number at most sqrt(2n), which is what the last task holds.
    """
    merged = counts.filter(F.col(column) > 0).groupBy(column).agg(F.count("*").alias("_n"))
    return merged.agg(F.expr(f"percentile({column}, {float(q)}D, _n)")).scalar()


def above_quantile(counts: DataFrame, column: str, q: float) -> DataFrame:
    """Rows strictly above the quantile of the positive counts."""
    return counts.filter(F.col(column) > count_quantile(counts, column, q))


def appearances(rows: DataFrame, player: str = "playerId") -> DataFrame:
    """Distinct matches per player, counted after one row per player and match.

    The first step splits a player with very many rows by match.
    """
    played = rows.groupBy(player, "matchId").agg(F.lit(1).alias("_one"))
    return played.groupBy(player).agg(F.count("matchId").alias("numero_presenze"))
