"""The end-to-end jobs: each takes tables and returns the published result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldline import fixed
from fieldline.functions.events import all_present
from fieldline.operators import cells, grid, motion, rates, roles, scaling, search, tables
from fieldline.operators.skew import HOT_ROWS
from fieldline.schema import GROUP, TEAM_PERIOD
from fieldline.session import discard, materialise
from fieldline.sources import readers


def pass_accuracy(events: DataFrame) -> DataFrame:
    """Mean and standard deviation of players' pass accuracy by team."""
    team, mean, spread = fixed.ACCURACY_COLUMNS
    return (
        rates.pass_accuracy_by_player(events)
        .groupBy(F.col("teamId").alias(team))
        .agg(
            F.bround(F.avg("accuracy"), 2).alias(mean),
            F.bround(F.stddev_samp("accuracy"), 2).alias(spread),
        )
    )


def top_tacklers(events: DataFrame, names: DataFrame, q: float = 0.75) -> DataFrame:
    """Players who won more tackles than the upper quartile of winners."""
    player, name, won = fixed.TACKLE_COLUMNS
    best = rates.above_quantile(rates.tackles_by_player(events), "n_tackles_won", q)
    return tables.with_names(best, names, "inner").select(
        F.col("playerId").alias(player), F.col("name").alias(name), F.col("n_tackles_won").alias(won)
    )


def grid_frequency(events: DataFrame) -> DataFrame:
    return grid.grid_frequencies(cells.without_no_player(events))


def grid_similarity(events: DataFrame, team_a, team_b) -> DataFrame:
    return grid.grid_similarity(grid_frequency(events), team_a, team_b)


def grid_dominance(events: DataFrame, team_a, team_b, tie: str | None = None) -> DataFrame:
    return grid.grid_dominance(grid_frequency(events), team_a, team_b, tie)


def match_grid_frequency(events: DataFrame, home: DataFrame | None = None) -> DataFrame:
    """Grid frequencies per match; sides are normalised if homes are given."""
    return grid.match_grid_frequencies(cells.without_no_player(events), home)


def cell_share_features(events: DataFrame) -> DataFrame:
    return cells.cell_shares(events)


def player_features(
    events: DataFrame,
    players: DataFrame,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The wide feature table: 54 features per match, period and player.

    Kinds of events are counted once per match, period, team and player. That
    table, a small part of the log, is written out: shares, season means, foot
    balance and group sizes all start from it. Positions need one more pass
    (see ``motion``).
    """
    specs = [*fixed.SHARE_SPECS, *fixed.SEASON_SPECS, *rates.FOOT_SPECS]
    counts = materialise(
        events.groupBy(*TEAM_PERIOD, "playerId").agg(
            F.count("*").alias(rates.ALL_EVENTS), *rates.spec_counts(specs)
        ),
        "player-counts",
    )
    sizes = counts.groupBy(*GROUP).agg(F.sum(rates.ALL_EVENTS).alias("_rows"))
    measures = motion.group_measures(events, GROUP, hot_rows, sizes)
    wide = measures.join(rates.shares_from_counts(counts), GROUP, "left")
    season = wide.join(_player_level(counts, players), "playerId", "left")
    return season.selectExpr(*GROUP, *[f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in fixed.FEATURES])


def _player_level(counts: DataFrame, players: DataFrame) -> DataFrame:
    """Season means, foot balance, height and weight: one row per player."""
    specs = [*fixed.SEASON_SPECS, *rates.FOOT_SPECS]
    per_match = (
        counts.filter(F.col("playerId").isNotNull())
        .groupBy("playerId", "matchId")
        .agg(*[F.expr(f"sum({s.count_column}) AS {s.count_column}") for s in specs])
    )
    season = per_match.groupBy("playerId").agg(
        *rates.season_measures(fixed.SEASON_SPECS),
        rates.foot_balance_measure(F.sum("n_left"), F.sum("n_right")).alias("ambidestro"),
    )
    bodies = players.select(F.col("wyId").alias("playerId"), "height", "weight")
    return season.join(bodies, "playerId", "left")


def match_measures(events: DataFrame) -> DataFrame:
    """The 18 measures per match and player: 16 shares, pace, and angles.

    Events are counted once per match, team and player; the team's totals stand
    beside those counts in one window, and one aggregate adds up the teams of a
    player. A share is null where the player has no such event.
    """
    keys = ["matchId", "playerId"]
    counts = rates.group_counts(events, ["matchId", "teamId", "playerId"], fixed.SHARE_SPECS)
    team = Window.partitionBy("matchId", "teamId")
    wholes = {
        f"_{s.name}": F.sum(s.count_column).over(team) if s.share_of == "team" else F.col(rates.ALL_EVENTS) for s in fixed.SHARE_SPECS
    }
    shares = []
    for s in fixed.SHARE_SPECS:
        part, names = F.sum(s.count_column), fixed.FOUL_SHARE_NAMES if s.name == "foul" else [s.share_column]
        shares += [F.when(part > 0, part / F.sum(f"_{s.name}")).alias(n) for n in names]
    own = counts.withColumns(wholes).filter(all_present(keys)).groupBy(*keys).agg(*shares)
    pace = events.filter(all_present(keys)).groupBy(*keys).agg(
        motion.event_rate_measure().alias("tempo_medio_tra_eventi"), *motion.angle_measures()
    )
    return pace.join(own, keys, "left")


def assemble_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All measures stored in a folder in one table: per match and player, with those per player beside them."""
    tall, keys_of = readers.read_measures(spark, folder)
    by_match, by_player = ("matchId", "playerId"), ("playerId",)
    wide = [tables.pivot_measures(tall, keys, sorted(n for n, k in keys_of.items() if k == keys)) for keys in (by_match, by_player)]
    return tables.assemble_measures([wide[0]], [wide[1]])


def assemble_measures(by_match: Sequence[DataFrame], by_player: Sequence[DataFrame]) -> DataFrame:
    return tables.assemble_measures(by_match, by_player)


def role_examples(spark, examples: Mapping[str, Sequence[Sequence[int]]] | None = None) -> dict[str, DataFrame]:
    """Known players per role, from the published lists unless given."""
    return {r: roles.example_groups(spark, g) for r, g in (examples or fixed.ROLE_EXAMPLES).items()}


def known_roles() -> dict[str, list[int]]:
    """Known midfielders and forwards count as such in their own model,
    whatever the player table says."""
    return {r: [p for group in fixed.ROLE_EXAMPLES[r] for p in group] for r in ("FW", "MD")}


def role_input(features: DataFrame, players: DataFrame) -> DataFrame:
    """The table that training and scoring read, several times each, so it is
    written out: features with role, gaps filled, top cells kept."""
    return materialise(roles.role_table(features, roles.classic_roles(players)), "role-input")


def train_roles(
    table: DataFrame,
    examples: Mapping[str, DataFrame],
    labels: Mapping[str, Sequence[str]] | None = None,
    overrides: Mapping[str, Sequence[int]] | None = None,
    max_iterations: int = roles.MAX_ITERATIONS,
    components: Mapping[str, int] | None = None,
    tolerance: float | None = None,
) -> dict[str, roles.RoleModel]:
    """Fit the role models on ``role_input``; a role without rows gets none.

    ``overrides`` adds players to a role in that role's own model, ``components``
    gives other numbers of components than the published ones.
    """
    labels, overrides, components = labels or fixed.ROLE_NAMES, overrides or {}, components or {}
    member = {
        role: (F.coalesce(F.col("role") == role, F.lit(False)) | F.col("playerId").isin(list(overrides[role])))
        if role in overrides
        else F.col("role") == role
        for role in examples
    }
    sizes = table.agg(*[F.count_if(own).alias(role) for role, own in member.items()]).first()
    trained = {role: table.filter(own) for role, own in member.items() if sizes[role]}
    if not trained:
        return {}
    return roles.train_models(
        trained, examples, labels, {r: components.get(r) or fixed.ROLE_COMPONENTS[r] for r in trained},
        max_iterations=max_iterations, tolerance=tolerance,
    )


def train_whole_roles(table: DataFrame, examples: Mapping[str, DataFrame], **settings) -> dict[str, roles.RoleModel]:
    """Role models that take feature rows as they are: the means that fill gaps and the choice of top cells belong to them.

    ``table`` has features with roles, gaps included. New rows are filled with
    the means of the rows that the models were trained on. ``settings`` are
    those of ``train_roles``.
    """
    stages = [scaling.fitted_fill(table, keep_null=["matchId", "playerId"]), scaling.top_cells_stage(table.columns)]
    prepared = table
    for stage in stages:
        prepared = stage.transform(prepared)
    stored = materialise(prepared, "role-rows")
    models = train_roles(stored, examples, **settings)
    discard(stored)
    return {role: model.prepared_by(stages) for role, model in models.items()}


def score_roles(models: Mapping[str, roles.RoleModel], table: DataFrame) -> DataFrame:
    """Label of every row of ``role_input``: (playerId, matchId, role, label)."""
    return roles.label_roles(models, table)


def role_report(
    models: Mapping[str, roles.RoleModel], table: DataFrame, players: DataFrame, teams: DataFrame
) -> DataFrame:
    """Each player's distinct labels with name, team and appearances."""
    labels = roles.label_roles(models, table).select("playerId", "label").distinct()
    people = players.select(F.col("wyId").alias("playerId"), "shortName", "currentTeamId")
    clubs = teams.select(F.col("wyId").alias("currentTeamId"), "officialName")
    named = rates.appearances(table).join(people, "playerId", "left").join(clubs, "currentTeamId", "left")
    return (
        named.join(labels, "playerId", "left")
        .select(
            *[
                F.col(c).alias(name)
                for c, name in zip(("playerId", "shortName", "officialName", "label", "numero_presenze"), fixed.REPORT_COLUMNS)
            ]
        )
        .orderBy("id_calciatore")
    )


def feature_search(pairs: DataFrame) -> DataFrame:
    """How often each feature was removed over all pairs, most often first."""
    return search.drop_counts(search.dropped_features(pairs)).orderBy(F.desc("n"), "feature")


def feature_difference(pairs_a: DataFrame, pairs_b: DataFrame) -> DataFrame:
    """Features removed for some pair of ``a`` and for none of ``b``."""
    return tables.difference(
        *[search.drop_counts(search.dropped_features(p)).select("feature") for p in (pairs_a, pairs_b)]
    )
