"""The registered queries: every operator and job on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldline import fixed
from fieldline.catalog import view
from fieldline.functions import events as ev
from fieldline.functions.vectors import nearest
from fieldline.operators import cells, grid, motion, quantiles, rates, roles, scaling, search, tables
from fieldline.plans import jobs
from fieldline.schema import GROUP, PERIOD
from fieldline.session import discard, materialise, new_path
from fieldline.sources import json_arrays, readers
from fieldline.sources.writers import write_csv, write_events, write_parquet

Query = Callable[[SparkSession, str], DataFrame]

TEAMS = (0, 1)
EXACT = ("elapsed", "tempo_medio_tra_eventi", "previous_sec")


def rounded(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Six decimals, so that the order of floating sums does not show.

    Times stay as they are: they are exact, and halves of a microsecond would
    be ties.
    """
    columns = columns or [n for n, t in df.dtypes if t == "double" and n not in EXACT]
    return df.selectExpr(*[f"round(`{c}`, 6) AS `{c}`" if c in columns else f"`{c}`" for c in df.columns])


def _spec(name: str):
    return next(s for s in fixed.SHARE_SPECS if s.name == name)


# --- one row per event ------------------------------------------------------
def tag_ids(spark, d):
    return view.events(spark, d).select(
        "id",
        F.array_join(F.col("tags").cast("array<string>"), ",").alias("tag_list"),
        F.size("tags").alias("n_tags"),
    )


def positions(spark, d):
    return view.events(spark, d).select(
        "id", F.col("y").alias("y_start"), F.col("x").alias("x_start"), "y_end", "x_end", "has_doublepos"
    )


def grid_cell(spark, d):
    cell = ev.cell_label(F.col("numero_cella_x"), F.col("numero_cella_y"))
    return view.events(spark, d).select("id", "numero_cella_x", "numero_cella_y", cell.alias("cell"))


def move_angle(spark, d):
    return rounded(view.events(spark, d).filter("has_doublepos").select("id", "angle"))


def move_distance(spark, d):
    padded = view.raw_events(spark, d).select("id", ev.padded_positions().alias("positions"))
    ends = [ev.coordinate(a, i) for i in (0, 1) for a in ("x", "y")]
    return rounded(padded.select("id", ev.point_distance(*ends).alias("distance")))


def select_event(spark, d):
    return view.events(spark, d).filter(ev.select_event(8, None, 1801)).select("id", "playerId")


def event_kinds(spark, d):
    specs = [*fixed.SHARE_SPECS, *fixed.SEASON_SPECS]
    counts = view.events(spark, d).agg(*rates.spec_counts(specs))
    kinds = [F.struct(F.lit(s.name).alias("kind"), F.col(s.count_column).alias("n")) for s in specs]
    return counts.select(F.inline(F.array(*kinds)))


def previous_event(spark, d):
    return rounded(motion.previous_event(view.events(spark, d)).select("id", *GROUP, "previous_sec"))


def two_position_pct(spark, d):
    return rounded(rates.two_position_share(view.events(spark, d)))


def _home(spark, d):
    return grid.home_teams(view.matches(spark, d), view.teams(spark, d))


def side_normalised(spark, d):
    return grid.normalise_sides(view.events(spark, d), _home(spark, d)).select("id", "x", "y")


# --- grids ------------------------------------------------------------------
def suffered_fouls(spark, d):
    activity = grid.cell_activity(view.events(spark, d), ["matchId", *grid.TEAM_CELL])
    return grid.suffered_fouls(activity).groupBy(*grid.TEAM_CELL).agg(F.sum("n_foul").alias("n_foul"))


def grid_matrix(spark, d):
    return rounded(grid.grid_matrix(jobs.grid_frequency(view.events(spark, d))))


# --- features ---------------------------------------------------------------
def _features(spark, d) -> DataFrame:
    return jobs.player_features(view.events(spark, d), view.players(spark, d))


def _stored_features(spark, d) -> DataFrame:
    return materialise(_features(spark, d), "features")


def _filled(spark, d) -> DataFrame:
    return roles.filled_table(_stored_features(spark, d), roles.classic_roles(view.players(spark, d)))


IDENT = ["playerId", "matchId", "matchPeriod"]


def impute(spark, d):
    return rounded(_filled(spark, d).select(*IDENT, "role", *fixed.FEATURES))


def _filled_by_player(spark, d) -> DataFrame:
    return scaling.impute(_stored_features(spark, d), keep_null=["matchId"], by=["playerId"])


def impute_by_role(spark, d):
    rows = roles.with_roles(_stored_features(spark, d), roles.classic_roles(view.players(spark, d)))
    filled = scaling.impute(materialise(rows, "with-roles"), keep_null=["matchId", "playerId"], by=["role"])
    return rounded(filled.select(*IDENT, "role", *fixed.FEATURES))


def impute_by_player(spark, d):
    return rounded(_filled_by_player(spark, d).select(*IDENT, *fixed.FEATURES))


def top_cells(spark, d):
    return scaling.keep_top_cells(_filled(spark, d)).select(*IDENT, *fixed.CELLS)


def minmax(spark, d):
    columns = list(dict.fromkeys([*fixed.SCALED_DF, *fixed.SCALED_FW_MD]))
    scaled = scaling.min_max_scale(materialise(_filled(spark, d), "filled"), columns)
    return rounded(scaled.select(*IDENT, *columns), columns)


def distance_histogram(spark, d):
    events = view.events(spark, d)
    classic = roles.classic_roles(view.players(spark, d))
    by_role = roles.with_roles(motion.total_distance(events), classic)
    return rounded(tables.histogram(by_role, "role", "total_distance", fixed.DISTANCE_BINS))


def assemble_measures(spark, d):
    events = view.events(spark, d)
    per_player = [rates.season_means(events), rates.foot_balance(events)]
    return rounded(jobs.assemble_measures([jobs.match_measures(events)], per_player))


def measure_folder(spark, d):
    """The same table by way of a folder of CSV files, one per measure or few of them."""
    events, folder = view.events(spark, d), new_path(spark, "measures")
    wide = materialise(jobs.match_measures(events), "match-measures")
    keys, pace = ["matchId", "playerId"], ["tempo_medio_tra_eventi", "angle_mean", "angle_std"]
    shares = [c for c in wide.columns if c not in {*keys, *pace}]
    for name, columns in {"shares_a": shares[::2], "shares_b": shares[1::2], pace[0]: pace[:1], "angles": pace[1:]}.items():
        write_csv(wide.select(*keys, *columns), f"{folder}/{name}.csv")
    write_csv(rates.season_means(events), f"{folder}/season.csv")
    write_csv(rates.foot_balance(events), f"{folder}/ambidestro.csv")
    discard(wide)
    return rounded(jobs.assemble_folder(spark, folder))


def distance_quantile(spark, d):
    """Quartiles of the distance covered, per role."""
    by_role = roles.with_roles(motion.total_distance(view.events(spark, d)), roles.classic_roles(view.players(spark, d)))
    return rounded(quantiles.quantiles(by_role, "total_distance", [0.25, 0.5, 0.75, 0.99], ["role"]), ["total_distance"])


def far_runners(spark, d):
    """Rows above the upper quartile of all distances."""
    found = quantiles.above_quantile(motion.total_distance(view.events(spark, d)), "total_distance", 0.75)
    return rounded(found.select(*GROUP, "total_distance"))


# --- tables -----------------------------------------------------------------
def role_override(spark, d):
    scorers = view.events(spark, d).filter(ev.has_tag(fixed.TAG_GOAL)).select("playerId")
    return roles.override_role(roles.classic_roles(view.players(spark, d)), scorers, "FW")


def idle_players(spark, d):
    known = view.players(spark, d).select(F.col("wyId").alias("playerId"))
    return tables.difference(known, view.events(spark, d).select("playerId"))


def top_tacklers(spark, d):
    return jobs.top_tacklers(view.events(spark, d), view.player_names(spark, d))


# --- vectors and roles --------------------------------------------------------
DIMENSIONS = 64


def seed_centroids(spark, d):
    means = roles.group_means(view.embeddings(spark, d), "label", DIMENSIONS)
    long = means.select(F.col("label").alias("seed_group"), F.posexplode("centre").alias("axis", "value"), "n")
    return rounded(long)


def _label_centres(points: DataFrame) -> list[list[float]]:
    means = roles.group_means(points, "label", DIMENSIONS).orderBy("label")
    return [list(r["centre"]) for r in means.collect()]  # one vector per label


def seeded_kmeans(spark, d):
    points = view.embeddings(spark, d)
    centres = roles.seeded_kmeans(points, _label_centres(points), tolerance=1e-18)  # until no point changes its centre
    near = nearest(F.col("components"), centres)
    found = points.select("vec_id", near.alias("near"))
    return rounded(found.select("vec_id", F.col("near.i").alias("cluster"), F.col("near.d").alias("cost")))


def _embedding_columns(spark, d) -> tuple[DataFrame, list[str]]:
    names = [f"v_{i}" for i in range(DIMENSIONS)]
    wide = view.embeddings(spark, d).select(
        "vec_id", *[F.expr(f"get(components, {i}) AS {n}") for i, n in enumerate(names)]
    )
    return wide, names


def pca_energy(spark, d):
    """Squared length of all components together: a full projection keeps it."""
    wide, names = _embedding_columns(spark, d)
    model = roles.principal_components(names, DIMENSIONS).fit(wide)
    parts = roles.transform_components(model, wide)
    energy = F.aggregate("components", F.lit(0.0), lambda s, v: s + v * v)
    return rounded(parts.select("vec_id", energy.alias("energy")))


def pca_components(spark, d):
    """The properties that make 18 directions the leading components, each checked on its own."""
    wide, names = _embedding_columns(spark, d)
    return roles.component_checks(roles.principal_components(names, 18).fit(wide), wide)


def random_kmeans(spark, d):
    clustered = roles.random_kmeans(view.embeddings(spark, d), 9, key="vec_id", tolerance=1e-18)  # until no point changes its centre
    return rounded(clustered.select("vec_id", "cluster", "cost"))


def pca_variance(spark, d):
    """Stated shares of variance of each role's components: their sum, and that of their squares."""
    table, found = jobs.role_input(_stored_features(spark, d), view.players(spark, d)), None
    for role in fixed.ROLE_NAMES:
        rows = table.filter(F.col("role") == role)
        model = roles.principal_components(fixed.FEATURES, len(fixed.FEATURES), roles.scaled_columns(role)).fit(rows)
        share = F.col("ratio")
        part = roles.explained_variance(model, spark).agg(
            F.lit(role).alias("role"), F.count("*").alias("components"), F.sum(share).alias("total"), F.sum(share * share).alias("squares"),
            F.max("cumulative").alias("cumulative"),
        )
        found = part if found is None else found.unionByName(part)
    return rounded(found)


def role_components(spark, d):
    """As ``pca_components``, for the components of each role's columns in their published numbers."""
    table, found = jobs.role_input(_stored_features(spark, d), view.players(spark, d)), None
    for role, k in fixed.ROLE_COMPONENTS.items():
        rows = table.filter(F.col("role") == role)
        model = roles.principal_components(fixed.FEATURES, k, roles.scaled_columns(role)).fit(rows)
        part = roles.component_checks(model, rows).withColumn("role", F.lit(role))
        found = part if found is None else found.unionByName(part)
    return found


def pca_moments(spark, d):
    """Sums of the first four powers of all component variances: the traces of powers of the covariance matrix."""
    wide, names = _embedding_columns(spark, d)
    model = roles.principal_components(names, DIMENSIONS).fit(wide)
    parts = roles.transform_components(model, wide)
    spread = parts.agg(*[F.var_samp(F.get("components", F.lit(i))).alias(f"v{i}") for i in range(DIMENSIONS)])
    powers = [F.struct(F.lit(p).alias("power"), sum(F.col(f"v{i}") ** p for i in range(DIMENSIONS)).alias("total")) for p in range(1, 5)]
    return rounded(spread.select(F.inline(F.array(*powers))))


def pca_crossed(spark, d):
    """Covariances of neighbouring components: all zero for principal components."""
    wide, names = _embedding_columns(spark, d)
    parts = roles.transform_components(roles.principal_components(names, DIMENSIONS).fit(wide), wide)
    crossed = [F.covar_samp(F.get("components", F.lit(i)), F.get("components", F.lit(i + 1))).alias(f"c{i}") for i in range(DIMENSIONS - 1)]
    rows = [F.struct(F.lit(i).alias("component"), (F.abs(F.col(f"c{i}")) < 1e-9).alias("uncorrelated")) for i in range(DIMENSIONS - 1)]
    return parts.agg(*crossed).select(F.inline(F.array(*rows)))


def _examples(players: DataFrame) -> dict[str, DataFrame]:
    """Every player of a role as an example, dealt by id over the role's
    clusters (the driver's tables name no known players)."""
    out = {}
    for role, labels in fixed.ROLE_NAMES.items():
        group = F.pmod(F.floor(F.col("wyId") / 5), F.lit(len(labels))).cast("int")
        out[role] = roles.classic_roles(players).filter(F.col("role") == role).select(
            F.col("wyId").alias("playerId"), group.alias("seed_group")
        )
    return out


def _trained(spark, d, full: bool = False):
    """Models, their table, and the players.

    ``full`` keeps all components and runs to the end: distances are then those
    of the scaled columns, which SQL can compute as well.
    """
    people = view.players(spark, d)
    table = jobs.role_input(_stored_features(spark, d), people)
    more = {"components": dict.fromkeys(fixed.ROLE_NAMES, len(fixed.FEATURES)), "tolerance": 1e-18} if full else {}
    return jobs.train_roles(table, _examples(people), **more), table, people


def role_clusters(spark, d, full: bool = False):
    models, table, _ = _trained(spark, d, full)
    return tables.value_counts(jobs.score_roles(models, table), "label")


def role_report(spark, d, full: bool = False):
    models, table, people = _trained(spark, d, full)
    return jobs.role_report(models, table, people, view.teams(spark, d))


def unknown_role(spark, d, full: bool = False):
    models, table, _ = _trained(spark, d, full)
    return roles.role_costs(models, table.filter(F.col("role").isNull()))


def seed_check(spark, d, full: bool = False):
    models, table, people = _trained(spark, d, full)
    labelled = materialise(jobs.score_roles(models, table).select("playerId", "label"), "labelled")  # read once for each role
    found, names = None, view.player_names(spark, d)
    for role, examples in _examples(people).items():
        part = roles.seed_check(labelled, examples, names).withColumn("examples_of", F.lit(role))
        found = part if found is None else found.unionByName(part)
    return found


def saved_roles(spark, d):
    """Models of one half of the matches, with the means that fill their gaps, saved, loaded, and applied to the other half."""
    people = view.players(spark, d)
    table = materialise(roles.with_roles(_features(spark, d), roles.classic_roles(people)), "with-roles")
    held = F.coalesce(F.col("matchId") % 2 == 0, F.lit(False))
    models = jobs.train_whole_roles(
        table.filter(~held), _examples(people), components=dict.fromkeys(fixed.ROLE_NAMES, len(fixed.FEATURES)), tolerance=1e-18
    )
    folder = new_path(spark, "models")
    for role, model in models.items():
        model.save(f"{folder}/{role}", spark)
    loaded = {role: roles.RoleModel.load(f"{folder}/{role}", spark) for role in models}
    return jobs.score_roles(loaded, table.filter(held)).groupBy("role", "label").agg(F.count("*").alias("n"))


# --- files: written to the shared folder and read back ---
EVENT_COLUMNS = ["id", "playerId", "matchId", "matchPeriod", "teamId", "eventId", "subEventId", "eventName", "eventSec", "x", "y", "x_end", "y_end"]


def _events_back(events: DataFrame) -> DataFrame:
    return events.select(*EVENT_COLUMNS, F.array_join(F.col("tags").cast("array<string>"), ",").alias("tag_list"))


def event_arrays(spark, d):
    """The log as JSON arrays, read by byte ranges."""
    path = new_path(spark, "event-arrays")
    json_arrays.write_arrays(view.raw_events(spark, d), path)
    return _events_back(readers.read_events(spark, path, layout="array"))


def event_ranges(spark, d):
    """One JSON array, read in ranges of 64 kB, of which a task takes many."""
    path = new_path(spark, "event-array")
    json_arrays.write_arrays(view.raw_events(spark, d), path, files=1)
    with json_arrays.ranges_of(spark, path, "64k"):
        return materialise(_events_back(readers.read_events(spark, path, layout="array")), "events-back")


def event_lines(spark, d):
    path = new_path(spark, "event-lines")
    view.raw_events(spark, d).write.json(path)
    return _events_back(readers.read_events(spark, path))


def event_parquet(spark, d):
    path = new_path(spark, "event-parquet")
    write_events(view.raw_events(spark, d), path)
    return _events_back(readers.read_events(spark, path, fmt="parquet"))


def dimension_files(spark, d):
    """Players, teams and matches as JSON files, read back with their schemas."""
    folder = new_path(spark, "dimensions")
    view.players(spark, d).coalesce(1).write.json(f"{folder}/players")
    view.teams(spark, d).coalesce(1).write.json(f"{folder}/teams")
    json_arrays.write_arrays(view.matches(spark, d).coalesce(1), f"{folder}/matches")
    view.player_names(spark, d).coalesce(1).write.json(f"{folder}/names")
    people = readers.read_players(spark, f"{folder}/players", "lines")
    parts = [
        people.select(F.lit("player").alias("kind"), F.col("wyId").alias("id"), F.concat_ws("|", "shortName", "lastName", "role.code2").alias("text"), F.col("height") + F.col("weight")),
        readers.read_teams(spark, f"{folder}/teams", "lines").select(F.lit("team"), "wyId", F.concat_ws("|", "name", "officialName"), F.lit(0.0)),
        readers.read_matches(spark, f"{folder}/matches").select(F.lit("match"), "wyId", "label", F.lit(0.0)),
        readers.read_player_names(spark, f"{folder}/names", "lines").select(F.lit("name"), "playerId", "name", F.lit(0.0)),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).toDF("kind", "id", "text", "size")


def feature_csv(spark, d):
    path = new_path(spark, "feature-csv")
    write_csv(_features(spark, d), path)
    return rounded(readers.read_feature_csv(spark, path, index_column=False).select(*GROUP, *fixed.FEATURES))


def ordered_report(spark, d):
    """Appearances in descending order, written and read back: the order is that of files and rows."""
    path = new_path(spark, "ordered")
    ordered = rates.appearances(view.events(spark, d)).orderBy(F.desc("numero_presenze"), "playerId")
    write_parquet(ordered, path)
    rows = spark.read.parquet(path).select("playerId", "numero_presenze", F.struct("_metadata.file_name", "_metadata.row_index").alias("at"))
    files = rows.groupBy("at.file_name").agg(F.count("*").alias("n"))
    before = files.select("file_name", (F.sum("n").over(Window.orderBy("file_name")) - F.col("n")).alias("before"))
    return rows.join(before, rows["at.file_name"] == before["file_name"]).select(
        "playerId", "numero_presenze", (F.col("before") + F.col("at.row_index")).alias("position")
    )


def player_lookup(spark, d):
    return tables.rows_of(view.player_names(spark, d), "playerId", [7, 14, 21])


def table_shape(spark, d):
    rows, columns = tables.shape(_features(spark, d))
    return spark.createDataFrame([(rows, columns)], "n_rows long, n_columns long")


# --- feature search -----------------------------------------------------------
def _pairs(spark, d) -> DataFrame:
    """First and second half of each player's matches, gaps filled with the player's own means."""
    return search.matched_pairs(_filled_by_player(spark, d), ["matchId", "playerId"], "matchPeriod", "1H", "2H")


def pair_cosine(spark, d):
    return rounded(search.pair_cosine(_pairs(spark, d)).select("matchId", "playerId", "cosine"))


def dropped_features(spark, d):
    dropped = search.dropped_features(_pairs(spark, d))
    return dropped.select(
        "matchId", "playerId", F.array_join("dropped", ",").alias("dropped"), F.size("dropped").alias("n_dropped")
    )


def feature_difference(spark, d):
    dropped = search.dropped_features(_pairs(spark, d)).withColumn("teamId", F.col("playerId") % 2)
    counts = search.drop_counts(dropped, ["teamId"], places=True)
    sides = [counts.filter(F.col("teamId") == t).select("place", "feature") for t in TEAMS]
    return tables.difference(*sides)


def most_dropped_feature(spark, d):
    dropped = search.dropped_features(_pairs(spark, d)).withColumn("teamId", F.col("playerId") % 2)
    return tables.best_of(search.drop_counts(dropped, ["teamId"]), "feature", "n", ["teamId"])


def _on_events(job: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: rounded(job(view.events(spark, d)))


def queries() -> dict[str, Query]:
    return {
        "tag_ids": tag_ids,
        "positions": positions,
        "grid_cell": grid_cell,
        "move_angle": move_angle,
        "move_distance": move_distance,
        "select_event": select_event,
        "event_kinds": event_kinds,
        "previous_event": previous_event,
        "two_position_pct": two_position_pct,
        "home_team": _home,
        "side_normalised": side_normalised,
        "pass_accuracy": lambda s, d: jobs.pass_accuracy(view.events(s, d)),
        "pass_accuracy_by_player": _on_events(
            lambda e: rates.pass_accuracy_by_player(e).select("playerId", "teamId", "accuracy")
        ),
        "tackle_counts": _on_events(rates.tackles_by_player),
        "top_tacklers": top_tacklers,
        "event_share_team": _on_events(lambda e: rates.share_of_team(e, _spec("shot"))),
        "event_share_player": _on_events(lambda e: rates.share_of_player(e, _spec("accurate_pass"))),
        "event_rates": _on_events(rates.event_shares),
        "season_mean": _on_events(rates.season_means),
        "foot_balance": _on_events(rates.foot_balance),
        "appearances": _on_events(rates.appearances),
        "position_dispersion": _on_events(motion.position_dispersion),
        "elapsed_time": _on_events(motion.elapsed_time),
        "event_rate": _on_events(motion.event_rate),
        "angle_stats": _on_events(motion.angle_stats),
        "total_distance": _on_events(motion.total_distance),
        "cell_counts": _on_events(cells.cell_counts),
        "match_cell_counts": _on_events(lambda e: cells.cell_counts(e, PERIOD)),
        "cell_share": _on_events(jobs.cell_share_features),
        "grid_frequency": _on_events(jobs.grid_frequency),
        "grid_matrix": grid_matrix,
        "grid_similarity": _on_events(lambda e: jobs.grid_similarity(e, *TEAMS)),
        "grid_dominance": _on_events(lambda e: jobs.grid_dominance(e, *TEAMS)),
        "suffered_fouls": suffered_fouls,
        "match_grid_frequency": _on_events(jobs.match_grid_frequency),
        "match_grid_frequency_sides": lambda s, d: rounded(jobs.match_grid_frequency(view.events(s, d), _home(s, d))),
        "player_features": lambda s, d: rounded(_features(s, d)),
        "impute": impute,
        "impute_by_player": impute_by_player,
        "impute_by_role": impute_by_role,
        "top_cells": top_cells,
        "minmax": minmax,
        "distance_histogram": distance_histogram,
        "distance_quantile": distance_quantile,
        "far_runners": far_runners,
        "assemble_measures": assemble_measures,
        "measure_folder": measure_folder,
        "role_override": role_override,
        "value_counts": lambda s, d: tables.value_counts(view.events(s, d), "matchPeriod"),
        "distinct_roles": lambda s, d: tables.distinct_values(roles.classic_roles(view.players(s, d)), "role"),
        "group_count": lambda s, d: tables.number_of_groups(view.events(s, d), GROUP),
        "idle_players": idle_players,
        "name_search": lambda s, d: tables.find_player(view.players(s, d), "7.*9").select("wyId", "lastName"),
        "seed_centroids": seed_centroids,
        "seeded_kmeans": seeded_kmeans,
        "random_kmeans": random_kmeans,
        "pca_energy": pca_energy,
        "pca_moments": pca_moments,
        "pca_crossed": pca_crossed,
        "pca_components": pca_components,
        "pca_variance": pca_variance,
        "role_clusters": role_clusters,
        "role_clusters_full": lambda s, d: role_clusters(s, d, full=True),
        "role_report": role_report,
        "role_report_full": lambda s, d: role_report(s, d, full=True),
        "unknown_role": unknown_role,
        "unknown_role_full": lambda s, d: rounded(unknown_role(s, d, full=True)),
        "seed_check": seed_check,
        "seed_check_full": lambda s, d: seed_check(s, d, full=True),
        "role_components": role_components,
        "saved_roles": saved_roles,
        "event_arrays": event_arrays,
        "event_ranges": event_ranges,
        "event_lines": event_lines,
        "event_parquet": event_parquet,
        "dimension_files": dimension_files,
        "feature_csv": feature_csv,
        "ordered_report": ordered_report,
        "player_lookup": player_lookup,
        "table_shape": table_shape,
        "pair_cosine": pair_cosine,
        "dropped_features": dropped_features,
        "feature_search": lambda s, d: jobs.feature_search(_pairs(s, d)),
        "feature_difference": feature_difference,
        "most_dropped_feature": most_dropped_feature,
    }
