import numpy as np
import pytest
from conftest import by_key
from pyspark.sql import functions as F

from fieldline import fixed
from fieldline.operators import roles
from fieldline.plans import jobs
from fieldline.schema import GROUP


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    return rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 5


def as_columns(spark, data):
    names = [f"v{i}" for i in range(data.shape[1])]
    rows = [(i, *map(float, r)) for i, r in enumerate(data)]
    return spark.createDataFrame(rows, "playerId long, " + ", ".join(f"{n} double" for n in names)), names


def test_components_equal_numpy_up_to_sign(spark, cloud):
    df, names = as_columns(spark, cloud)
    model = roles.principal_components(names, 3).fit(df)
    got = roles.component_columns(roles.transform_components(model, df).select("playerId", "components"), 3)
    assert got.columns == ["playerId", "c_0", "c_1", "c_2"]
    parts = np.array([r[1:] for r in got.orderBy("playerId").collect()])
    centred = cloud - cloud.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    want = centred @ vt[:3].T
    assert np.allclose(np.abs(parts), np.abs(want))
    ratios = [r["ratio"] for r in roles.explained_variance(model, spark).orderBy("component").collect()]
    assert np.allclose(ratios, (s**2 / (s**2).sum())[:3])


def test_full_rank_explains_everything_and_constants_do_not_matter(spark, cloud):
    data = np.hstack([cloud, np.full((200, 1), 4.0)])
    df, names = as_columns(spark, data)
    model = roles.principal_components(names, 7, scaled=names[4:]).fit(df)
    assert roles.explained_variance(model, spark).agg(F.max("cumulative")).first()[0] == pytest.approx(1)


def lloyd(data, centres, rounds):
    centres = np.array(centres, dtype=float)
    for _ in range(rounds):
        near = ((data[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([data[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
        if np.allclose(moved, centres, atol=0):
            break
        centres = moved
    return centres


@pytest.mark.parametrize("rounds", [1, 4, 50])
def test_seeded_kmeans_equals_plain_rounds(spark, cloud, rounds):
    points = spark.createDataFrame([(list(map(float, r)),) for r in cloud], "components array<double>")
    start = [list(map(float, r)) for r in cloud[:4]] + [[1000.0] * 6]  # the last one gets no points
    got = roles.seeded_kmeans(points, start, max_iterations=rounds, tolerance=0.0)
    assert np.allclose(got, lloyd(cloud, start, rounds))


def test_blobs_keep_their_seed(spark):
    rng = np.random.default_rng(0)
    blobs = [(g * 50 + i, rng.normal(g * 10, 0.1, 2).tolist(), g) for g in range(3) for i in range(50)]
    points = spark.createDataFrame([(i, p) for i, p, _ in blobs], "playerId long, components array<double>")
    examples = roles.example_groups(spark, [[0, 1], [50], [100, 101, 102]])
    centres = roles.seed_centres(points, examples, 3, 2)
    final = roles.seeded_kmeans(points, centres)
    near = roles.nearest(F.col("components"), final)["i"].alias("c")
    got = {r["playerId"]: r["c"] for r in points.select("playerId", near).collect()}
    assert all(got[i] == g for i, _, g in blobs)
    with pytest.raises(ValueError, match=r"\[2\]"):
        roles.seed_centres(points, roles.example_groups(spark, [[0], [50], [999]]), 3, 2)


def test_kmeans_warns_when_stopped_and_ends_at_a_fixpoint(spark, cloud):
    points = spark.createDataFrame([([float(v) for v in r],) for r in cloud], "components array<double>")
    start = [list(map(float, cloud[i])) for i in range(4)]
    with pytest.warns(UserWarning, match="still moves"):
        roles.seeded_kmeans(points, start, max_iterations=1, tolerance=0.0)
    centres = np.array(roles.seeded_kmeans(points, start, tolerance=1e-18))
    near = ((cloud[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    assert np.allclose(centres, [cloud[near == i].mean(axis=0) for i in range(4)])


def test_random_start_does_not_depend_on_partitions(spark):
    draw = np.random.default_rng(5)
    data = np.concatenate([draw.normal(10 * g, 0.5, (40, 3)) for g in range(4)])
    rows = [(i, list(map(float, r))) for i, r in enumerate(data)]
    points = spark.createDataFrame(rows, "playerId long, components array<double>")
    starts = [roles.random_centres(points.repartition(n, "playerId"), 4, seed=7) for n in (1, 4, 16)]
    assert starts[0] == starts[1] == starts[2] and roles.random_centres(points, 4, seed=8) != starts[0]
    assert {tuple(c) for c in starts[0]} <= {tuple(r[1]) for r in rows}
    found = [[(r["playerId"], r["cluster"]) for r in roles.random_kmeans(points.repartition(n), 4, seed=7).orderBy("playerId").collect()] for n in (1, 16)]
    assert found[0] == found[1]
    assert len({c for _, c in found[0]}) == 4 and all(len({c for i, c in found[0] if i // 40 == g}) == 1 for g in range(4))


def test_random_start_with_few_points(spark):
    points = spark.createDataFrame([(1, [0.0]), (2, [0.0]), (3, [1.0])], "playerId long, components array<double>")
    assert sorted(roles.random_centres(points, 5)) == [[0.0], [1.0]]
    with pytest.raises(ValueError, match="no points"):
        roles.random_centres(points.filter("playerId > 5"), 2)


def test_groups_of_points_are_clustered_side_by_side(spark, cloud):
    blocks = {"a": (cloud[:, :2], 3), "b": (cloud, 4), "c": (cloud[:20, :3] * 5, 2)}
    rows = [(g, list(map(float, r))) for g, (data, _) in blocks.items() for r in data]
    points = spark.createDataFrame(rows, "group string, components array<double>").repartition(5)
    start = {g: [list(map(float, r)) for r in data[:k]] for g, (data, k) in blocks.items()}
    got = roles.grouped_kmeans(points, start, tolerance=0.0)
    for g, (data, _) in blocks.items():
        assert np.allclose(got[g], lloyd(data, start[g], 100))


def test_rounds_read_blocks_of_points(spark, cloud):
    rows = [("a", list(map(float, r))) for r in cloud] + [("b", [float(i)]) for i in range(7)] + [("c", None)]
    points = spark.createDataFrame(rows, "group string, components array<double>").coalesce(1)
    packed = roles._packed(points, {"a": 6, "b": 1}).collect()
    assert len(packed) < len(rows) / 8 and {r["group"] for r in packed} == {"a", "b"}
    back = np.frombuffer(b"".join(bytes(r["block"]) for r in packed if r["group"] == "a")).reshape(-1, 6)
    assert np.array_equal(np.array(sorted(back.tolist())), np.array(sorted(cloud.tolist())))
    for bad in ({"a": 3}, {"c": 6}):
        with pytest.raises(Exception, match="that has not"):
            roles._packed(points, bad).collect()


def test_rounds_read_only_points_near_borders(spark, monkeypatch):
    draw = np.random.default_rng(8)
    data = draw.normal(size=(4_000, 3))
    read = []
    sums = roles._cluster_sums

    def counted(packed, *others):
        found = sums(packed, *others)
        read.append(sum(float(f[:, -1].sum()) for f in found.values()))
        return found

    monkeypatch.setattr(roles, "_cluster_sums", counted)
    points = spark.createDataFrame([("all", list(map(float, r))) for r in data], "group string, components array<double>")
    start = [list(map(float, r)) for r in data[:5]] + [[90.0] * 3]
    got = roles.grouped_kmeans(points, {"all": start}, tolerance=1e-18)["all"]
    assert np.allclose(got, lloyd(data, start, 300))
    assert len(read) > 20 and min(read) < 0.5 * len(data)


def test_component_signs_and_checks(spark, cloud):
    df, names = as_columns(spark, cloud)
    model = roles.principal_components(names, 3).fit(df)
    found = roles.loadings(model)
    assert all(c[np.abs(c).argmax()] > 0 for c in found.T)
    centred = cloud - cloud.mean(axis=0)
    parts = np.array([r["components"] for r in roles.transform_components(model, df).orderBy("playerId").collect()])
    assert np.allclose(parts, centred @ found)
    assert all(all(v for n, v in r.asDict().items() if n != "component") for r in roles.component_checks(model, df).collect())
    assert np.allclose(roles.covariance(df.select(F.array(*names).alias("v")), "v", cloud.shape[1]), np.cov(cloud.T))


def test_override_by_list_and_by_table(spark):
    df = spark.createDataFrame([(1, "MD"), (2, "MD"), (3, None)], "wyId long, role string")
    want = {1: {"role": "FW"}, 2: {"role": "MD"}, 3: {"role": "FW"}}
    assert by_key(roles.override_role(df, [1, 3], "FW"), "wyId") == want
    listed = spark.createDataFrame([(1,), (1,), (3,)], "playerId long")
    assert by_key(roles.override_role(df, listed, "FW"), "wyId") == want


def test_fixed_lists_are_consistent():
    assert len(fixed.SHARE_SPECS) == 15 and len(fixed.CELLS) == 25 and len(fixed.FEATURES) == 54
    assert len(set(fixed.FEATURES)) == 54 and len(fixed.SCALED_DF) == 10 and len(fixed.SCALED_FW_MD) == 12
    for role, groups in fixed.ROLE_EXAMPLES.items():
        assert len(groups) == len(fixed.ROLE_NAMES[role]) == len(fixed.ROLE_CODES[role])
    assert sum(len(g) for groups in fixed.ROLE_EXAMPLES.values() for g in groups) == 57
    assert len(jobs.known_roles()["MD"]) == 27


@pytest.fixture(scope="module")
def season(spark):
    """40 players per role, two matches each; player 0..4 of a role mark its blobs."""
    rng = np.random.default_rng(8)
    rows, people = [], []
    for r, role in enumerate(["DF", "MD", "FW"]):
        k = len(fixed.ROLE_NAMES[role])
        for p in range(45):
            player = 100 * (r + 1) + p
            people.append((player, f"P{player}", f"L{player}", 1, 180.0, 70.0, (role if p < 44 else None, None)))
            level = np.zeros(len(fixed.FEATURES))
            level[(p % k) * 3] = 5 + r
            for match in (1, 2):
                values = level + rng.random(len(fixed.FEATURES)) * 0.2
                rows.append((match, "1H", player, *map(float, values)))
    people.append((999, "Idle", "Idle", 2, 170.0, 60.0, ("DF", None)))
    columns = ", ".join(["matchId long", "matchPeriod string", "playerId long", *[f"`{c}` double" for c in fixed.FEATURES]])
    from fieldline.schema import PLAYER_SCHEMA, TEAM_SCHEMA

    return (
        spark.createDataFrame(rows, columns),
        spark.createDataFrame(people, PLAYER_SCHEMA),
        spark.createDataFrame([(1, "One", "One FC")], TEAM_SCHEMA),
    )


@pytest.fixture(scope="module")
def trained(spark, season):
    features, players, _ = season
    table = jobs.role_input(features, players)
    groups = {
        role: [[100 * (r + 1) + p] for p in range(len(fixed.ROLE_NAMES[role]))] for r, role in enumerate(["DF", "MD", "FW"])
    }
    return jobs.train_roles(table, jobs.role_examples(spark, groups)), table, groups


def test_role_table_keeps_idle_players(season, trained):
    _, table, _ = trained
    idle = table.filter("playerId = 999").collect()
    assert len(idle) == 1 and idle[0]["matchId"] is None and idle[0]["role"] == "DF"
    assert table.count() == 45 * 3 * 2 + 1 and set(GROUP) <= set(table.columns)
    row = table.filter("playerId = 100").first()
    assert sum(row[c] > 0 for c in fixed.CELLS) == 3


def test_training_labels_examples_with_their_own_group(trained):
    models, table, groups = trained
    assert set(models) == {"DF", "MD", "FW"}
    labelled = jobs.score_roles(models, table)
    seen = {(r["playerId"], r["label"]) for r in labelled.collect()}
    for role, lists in groups.items():
        for i, (player,) in enumerate(lists):
            assert (player, fixed.ROLE_NAMES[role][i]) in seen


def test_report(season, trained):
    models, table, groups = trained
    _, players, teams = season
    rows = jobs.role_report(models, table, players, teams).collect()
    assert [r["id_calciatore"] for r in rows] == sorted(r["id_calciatore"] for r in rows)
    assert len({(r["id_calciatore"], r["wyrole"]) for r in rows}) == len(rows)
    found = {r["id_calciatore"]: r for r in rows}
    assert found[100]["numero_presenze"] == 2 and found[100]["nome_squadra"] == "One FC"
    assert found[999]["numero_presenze"] == 0 and found[999]["nome_squadra"] is None
    assert found[144]["wyrole"] is not None  # no classic role: best fitting model
    check = roles.seed_check(
        jobs.score_roles(models, table), roles.example_groups(table.sparkSession, groups["DF"]),
        players.select(F.col("wyId").alias("playerId"), F.col("shortName").alias("name")),
    )
    assert by_key(check, "playerId", "label")[(100, fixed.ROLE_NAMES["DF"][0])] == {"n": 2, "name": "P100"}


def test_unknown_rows_go_to_the_cheapest_model(trained):
    models, table, _ = trained
    unknown = table.filter(F.col("role").isNull())
    costs = {r["role"]: r["cost"] for r in roles.role_costs(models, unknown).collect()}
    assert roles.best_role(models, unknown) == min(costs, key=costs.get)
    assert roles.best_role(models, unknown.limit(0)) is None


def test_models_survive_saving(spark, trained, tmp_path):
    models, table, _ = trained
    model = models["DF"]
    model.save(str(tmp_path / "df"), spark)
    again = roles.RoleModel.load(str(tmp_path / "df"), spark)
    assert (again.role, again.labels, again.centres) == (model.role, model.labels, model.centres)
    rows = table.filter("role = 'DF'")
    key = ["playerId", "matchId", "label"]
    assert sorted(again.predict(rows).select(*key).collect(), key=str) == sorted(model.predict(rows).select(*key).collect(), key=str)


def test_overrides_and_missing_roles(spark, trained):
    _, table, groups = trained
    only = table.filter("role = 'DF'")
    examples = jobs.role_examples(spark, {"DF": groups["DF"], "MD": groups["MD"], "FW": [[p] for p in range(110, 115)]})
    models = jobs.train_roles(only, examples, overrides={"FW": list(range(110, 144))}, max_iterations=3)
    assert set(models) == {"DF", "FW"}
