import numpy as np
import pytest
from conftest import by_key

from fieldline import fixed
from fieldline.operators import scaling, tables


def test_value_counts_and_distinct(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "v string")
    assert [tuple(r) for r in tables.value_counts(df, "v").collect()] == [("a", 2), ("b", 1)]
    assert {r["v"] for r in tables.distinct_values(df, "v").collect()} == {"a", "b", None}
    assert tables.number_of_groups(df, ["v"]).first()[0] == 2
    assert tables.shape(df) == (4, 1)
    assert {r["v"] for r in tables.rows_of(df, "v", ["b"]).collect()} == {"b"}


def test_difference_is_of_sets(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "n string")
    b = spark.createDataFrame([("y",)], "n string")
    assert [r["n"] for r in tables.difference(a, b).collect()] == ["x"]


def test_best_of_and_search(spark):
    df = spark.createDataFrame([(1, "b", 3), (1, "a", 3), (1, "c", 2), (2, "z", 0)], "k long, item string, n long")
    assert by_key(tables.best_of(df, "item", "n", ["k"]), "k") == {1: {"item": "a"}, 2: {"item": "z"}}
    assert tables.best_of(df, "item", "n").first()["item"] == "a"
    people = spark.createDataFrame([("Rossi",), ("De Rossi",), ("Verdi",)], "lastName string")
    assert tables.find_player(people, "Ros").count() == 2


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(1)
    values = {"DF": rng.random(200) * 10, "FW": rng.random(50), "GK": rng.random(5), "MD": np.array([2.0])}
    rows = [(r, float(v)) for r, vs in values.items() for v in vs]
    got = tables.histogram(spark.createDataFrame(rows, "role string, d double"), "role", "d", fixed.DISTANCE_BINS)
    found = by_key(got, "role", "bin")
    for role in ("DF", "FW"):
        counts, edges = np.histogram(values[role], bins=fixed.DISTANCE_BINS[role])
        for i, n in enumerate(counts):
            assert found.get((role, i), {"n": 0})["n"] == n
            if n:
                assert found[(role, i)]["bin_start"] == pytest.approx(edges[i])
    assert found[("MD", 0)]["n"] == 1 and not any(k[0] == "GK" for k in found)


def test_merge_measures_is_a_full_join(spark):
    a = spark.createDataFrame([(1, 1, 0.5), (1, 2, None)], "matchId long, playerId long, a double")
    b = spark.createDataFrame([(1, 2, 7.0), (2, 2, 8.0), (None, 3, 1.0)], "matchId long, playerId long, b double")
    got = by_key(tables.merge_measures({"a": a, "b": b}, ["matchId", "playerId"]), "matchId", "playerId")
    assert got == {(1, 1): {"a": 0.5, "b": None}, (1, 2): {"a": None, "b": 7.0}, (2, 2): {"a": None, "b": 8.0}}


def test_merge_measures_refuses_repeated_keys(spark):
    a = spark.createDataFrame([(1, 0.5), (1, 0.6)], "playerId long, a double")
    with pytest.raises(Exception, match="occurs twice"):
        tables.merge_measures([a], ["playerId"]).collect()


def test_assemble_keeps_players_of_either_side(spark):
    a = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.1)], "matchId long, playerId long, a double")
    p = spark.createDataFrame([(1, 2.0), (9, 3.0)], "playerId long, p double")
    got = by_key(tables.assemble_measures([a], [p]), "playerId")
    assert got == {1: {"matchId": 1, "a": 0.5, "p": 2.0}, 9: {"matchId": None, "a": None, "p": 3.0}}


def test_merging_refuses_equal_names_and_repeated_keys(spark):
    a = spark.createDataFrame([(1, 1, 1.0)], "matchId long, playerId long, a double")
    with pytest.raises(ValueError, match="more than one table"):
        tables.merge_measures([a, a], ["matchId", "playerId"])
    many = [a.select("matchId", "playerId", a["a"].alias(f"m{i}")) for i in range(70)]
    assert len(tables.merge_measures(many, ["matchId", "playerId"]).collect()) == 1
    with pytest.raises(Exception, match="occurs twice"):
        tables.merge_measures([a.union(a)], ["matchId", "playerId"]).collect()


def test_impute_by_group(spark):
    df = spark.createDataFrame(
        [(1, 10, 2.0, None), (1, 11, None, 5.0), (2, 12, None, None), (None, 13, 4.0, 1.0), (None, 14, None, 2.0)],
        "playerId long, matchId long, angle_mean double, gol double",
    )
    rows = {r["matchId"]: r for r in scaling.impute(df, mean_of=["angle_mean"], keep_null=["matchId"], by=["playerId"]).collect()}
    assert [rows[m]["angle_mean"] for m in (10, 11, 12, 13, 14)] == [2.0, 2.0, 0.0, 4.0, 4.0]
    assert [rows[m]["gol"] for m in (10, 11, 12, 13, 14)] == [0.0, 5.0, 0.0, 1.0, 2.0] and rows[13]["playerId"] is None


def test_impute_means_and_zeros(spark):
    df = spark.createDataFrame(
        [(1, 2.0, None, None, 1.0, "x"), (2, None, 4.0, 1.0, None, None), (None, 4.0, 6.0, None, 3.0, "y")],
        "playerId long, angle_mean double, height double, weight double, ambidestro double, role string",
    ).selectExpr("*", "CAST(NULL AS DOUBLE) AS angle_std")
    rows = scaling.impute(df, keep_null=["playerId"]).collect()
    assert [r["angle_mean"] for r in rows] == [2.0, 3.0, 4.0] and [r["height"] for r in rows] == [5.0, 4.0, 6.0]
    assert [r["angle_std"] for r in rows] == [0.0] * 3 and rows[2]["playerId"] is None and rows[1]["role"] is None


def test_min_max_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (2.0, 5.0)], "a double, c double")
    assert [tuple(r) for r in scaling.min_max_scale(df, ["a", "c"]).collect()] == [(0.0, 0.0), (1.0, 0.0), (0.5, 0.0)]
