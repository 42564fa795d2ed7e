import numpy as np
import pytest
from conftest import by_key

from fieldline import fixed
from fieldline.operators import search
from fieldline.plans import jobs


def cosine(a, b):
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(np.dot(a, b) / size), 12) if size else float("nan")


def brute_drops(a, b, names, limit=10):
    """The same greedy removal, recomputing every cosine from scratch."""
    a, b, names, dropped = list(a), list(b), list(names), []
    score = cosine(a, b)
    while len(dropped) < limit:
        best, place = score, None
        for i in range(len(a)):
            s = cosine(a[:i] + a[i + 1 :], b[:i] + b[i + 1 :])
            if s > best:
                best, place = s, i
        if place is None:
            break
        dropped.append(names[place])
        score = best
        for part in (a, b, names):
            del part[place]
    return dropped


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    out = {}
    for i in range(40):
        a, b = np.round(rng.random((2, 12)) * rng.choice([1, 1, 50], 12), 3)
        zero = rng.random(12) < 0.3
        out[i] = (np.where(zero, 0, a).tolist(), np.where(zero, 0, b).tolist())
    out[100] = ([1.0] * 12, [1.0] * 12)  # equal rows: nothing to gain
    return out


NAMES = [f"f{i}" for i in range(12)]


def test_greedy_removal_against_brute_force(spark, vectors):
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in vectors.items()], "id long, a array<double>, b array<double>")
    got = by_key(search.dropped_features(pairs, NAMES), "id")
    for i, (a, b) in vectors.items():
        assert got[i]["dropped"] == brute_drops(a, b, NAMES), i
    assert got[100]["dropped"] == []
    short = by_key(search.dropped_features(pairs, NAMES, max_drops=2), "id")
    assert all(short[i]["dropped"] == got[i]["dropped"][:2] for i in vectors)


def test_pair_cosine(spark, vectors):
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in vectors.items()], "id long, a array<double>, b array<double>")
    got = by_key(search.pair_cosine(pairs).select("id", "cosine"), "id")
    assert all(got[i]["cosine"] == pytest.approx(cosine(a, b)) for i, (a, b) in vectors.items())


def test_pairs_are_matched_by_key(spark):
    rows = [(1, "1H", 5, 1.0), (1, "2H", 5, 2.0), (2, "1H", 5, 3.0), (1, "1H", 6, 4.0), (1, "2H", 6, 5.0)]
    df = spark.createDataFrame(rows, "matchId long, matchPeriod string, playerId long, v double")
    halves = search.matched_pairs(df, ["matchId", "playerId"], "matchPeriod", "1H", "2H", ["v"])
    assert by_key(halves, "matchId", "playerId") == {(1, 5): {"a": [1.0], "b": [2.0]}, (1, 6): {"a": [4.0], "b": [5.0]}}
    players = search.matched_pairs(df, ["matchId", "matchPeriod"], "playerId", 5, 6, ["v"])
    assert by_key(players, "matchId", "matchPeriod") == {(1, "1H"): {"a": [1.0], "b": [4.0]}, (1, "2H"): {"a": [2.0], "b": [5.0]}}


def test_counts_and_difference(spark):
    dropped = spark.createDataFrame([(["x", "y"],), (["x"],), ([],)], "dropped array<string>")
    assert by_key(search.drop_counts(dropped), "feature") == {"x": {"n": 2}, "y": {"n": 1}}
    n = len(fixed.PLAY_FEATURES)
    a = [1.0] * n
    a[0], b = 9.0, [1.0] * n
    pairs = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    same = spark.createDataFrame([(b, b)], "a array<double>, b array<double>")
    assert [tuple(r) for r in jobs.feature_search(pairs).collect()] == [("foul_pct_WRT_x", 1)]
    assert [r[0] for r in jobs.feature_difference(pairs, same).collect()] == ["foul_pct_WRT_x"]


def test_pairs_refuse_a_second_row_and_read_gaps_as_zero(spark):
    names = ["f", "g", "h"]
    rows = spark.createDataFrame([(1, "a", 1.0, None, 2.0), (1, "b", 1.0, 3.0, 2.0)], "k long, s string, f double, g double, h double")
    pairs = search.matched_pairs(rows, ["k"], "s", "a", "b", names)
    assert search.dropped_features(pairs, names).collect()[0]["dropped"] == ["g"]
    with pytest.raises(Exception, match="two rows"):
        search.matched_pairs(rows.union(rows), ["k"], "s", "a", "b", names).collect()
