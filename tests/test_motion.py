import math

import numpy as np
import pytest
from conftest import by_key, event

from fieldline.operators import motion
from fieldline.operators.cells import cell_counts, cell_shares
from fieldline.operators.skew import split_hot
from fieldline.plans import jobs
from fieldline import fixed
from fieldline.schema import GROUP, PERIOD


def walk(n=60, player=1, same_time=False, seed=0, start=0):
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 101, (n, 2)).astype(float).tolist()
    times = np.zeros(n) if same_time else np.round(rng.random(n) * 100, 3)
    return [
        event(start + i, player=player, sec=float(times[i]), at=(tuple(points[i]), tuple(points[i][::-1])))
        for i in range(n)
    ]


def expected(rows):
    """The same measures by plain loops."""
    rows = sorted(rows, key=lambda r: (r[8], r[0]))
    xy = np.array([(r[10][0][1], r[10][0][0]) for r in rows])
    centre = xy.mean(axis=0)
    steps = np.sqrt((np.diff(xy, axis=0) ** 2).sum(axis=1))
    return {
        "posizione_media_x": centre[0],
        "posizione_media_y": centre[1],
        "standard_deviation": np.sqrt(((xy - centre) ** 2).sum(axis=1)).mean(),
        "total_distance": steps.sum(),
        "tempo_medio_tra_eventi": (rows[-1][8] - rows[0][8]) / len(rows),
    }


HOT = [{}, {"hot_rows": 40}, {"hot_rows": 10}, {"hot_rows": 3}]


@pytest.mark.parametrize("skew", HOT)
@pytest.mark.parametrize("same_time", [False, True])
def test_group_measures_with_and_without_hot_groups(make_events, skew, same_time):
    groups = {1: walk(80, 1, same_time), 2: walk(30, 2, same_time, 1, 1000), 3: walk(4, 3, same_time, 2, 2000)}
    got = by_key(motion.group_measures(make_events(*sum(groups.values(), [])), **skew), *GROUP)
    assert len(got) == 3
    for player, rows in groups.items():
        for name, value in expected(rows).items():
            assert got[(1, "1H", player)][name] == pytest.approx(value), (player, name)
        assert sum(got[(1, "1H", player)][c] for c in fixed.CELLS) == len(rows)


def test_single_event_and_still_move(make_events):
    events = make_events(event(1, at=((10.0, 20.0),), sec=5.0), event(2, player=2, at=((3.0, 3.0), (3.0, 3.0))))
    got = by_key(motion.group_measures(events), *GROUP)
    one = got[(1, "1H", 1)]
    assert one["total_distance"] == 0 and one["standard_deviation"] == 0 and one["tempo_medio_tra_eventi"] == 0
    assert one["angle_mean"] is None and one["angle_std"] is None
    still = got[(1, "1H", 2)]
    assert still["angle_mean"] == math.pi / 2 and still["angle_std"] is None


def test_a_repeated_event_counts_once_in_the_rate(make_events):
    events = make_events(event(1, sec=0.0), event(2, sec=6.0), event(2, sec=6.0))
    assert motion.event_rate(events).first()["tempo_medio_tra_eventi"] == 3.0
    assert by_key(motion.group_measures(events), *GROUP)[(1, "1H", 1)]["tempo_medio_tra_eventi"] == 3.0


def test_single_measures_agree_with_all(make_events):
    rows = walk(20, 1) + walk(7, 2, seed=3, start=500)
    events = make_events(*rows)
    every = by_key(motion.group_measures(events), *GROUP)
    singles = [
        motion.position_dispersion(events), motion.total_distance(events), motion.event_rate(events),
        motion.angle_stats(events), cell_counts(events),
    ]
    for single in singles:
        for key, values in by_key(single, *GROUP).items():
            for name, value in values.items():
                assert every[key][name] == pytest.approx(value)
    elapsed = by_key(motion.elapsed_time(events), *GROUP)[(1, "1H", 1)]["elapsed"]
    assert elapsed == pytest.approx(every[(1, "1H", 1)]["tempo_medio_tra_eventi"] * 20)


def test_previous_event(make_events):
    events = make_events(event(1, sec=5.0), event(2, sec=1.0), event(3, sec=1.0, player=2))
    assert by_key(motion.previous_event(events).select("id", "previous_sec"), "id") == {
        1: {"previous_sec": 1.0}, 2: {"previous_sec": None}, 3: {"previous_sec": None},
    }


@pytest.mark.parametrize("same_time", [False, True])
def test_previous_event_of_hot_groups(make_events, same_time):
    events = make_events(*walk(90, 1, same_time), *walk(25, 2, same_time, 4, 500), *walk(3, 3, start=900))
    want = by_key(motion.previous_event(events).select("id", "previous_sec"), "id")
    for skew in ({"hot_rows": 30}, {"hot_rows": 10}, {"hot_rows": 2}):
        got = motion.previous_event(events, **skew)
        assert got.columns == motion.previous_event(events).columns
        assert by_key(got.select("id", "previous_sec"), "id") == want


def test_split_hot_keeps_every_row(spark, make_events):
    events = make_events(*walk(30, 1), *walk(5, 2, start=100), *walk(20, 3, start=200))
    ordinary, hot = split_hot(events, GROUP, hot_rows=10)
    assert {r["playerId"] for r in hot.collect()} == {1, 3} and {r["playerId"] for r in ordinary.collect()} == {2}
    assert hot.count() == 50 and ordinary.count() == 5
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    pieces = motion._in_ranges(hot, GROUP).groupBy("_piece").count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(pieces) > 2 and max(r["count"] for r in pieces) <= 30
    assert split_hot(events, GROUP).hot.count() == 0


def test_nothing_runs_while_a_plan_is_made(spark, make_events):
    events = make_events(*walk(30, 1), *walk(5, 2, start=100))
    spark.sparkContext.setJobGroup("making plans", "")
    made = [motion.previous_event(events), motion.position_dispersion(events), motion.total_distance(events)]
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("making plans")) == []
    spark.sparkContext.setJobGroup("", "")
    assert [m.count() for m in made] == [35, 2, 2]


def test_cell_shares(make_events):
    at = ((10.0, 10.0),)
    events = make_events(
        event(1, at=at), event(2, player=2, at=at), event(3, player=2, at=at), event(4, player=0, at=at),
        event(5, player=2, at=((90.0, 90.0),)),
    )
    got = by_key(cell_shares(events), *GROUP)
    assert set(got) == {(1, "1H", 1), (1, "1H", 2)}
    assert got[(1, "1H", 1)]["00"] == pytest.approx(1 / 3) and got[(1, "1H", 1)]["44"] == 0.0
    assert got[(1, "1H", 2)]["44"] == 1.0 and got[(1, "1H", 2)]["22"] is None
    assert by_key(cell_counts(events, PERIOD), *PERIOD)[(1, "1H")]["00"] == 4


def test_player_features_columns_and_players(spark, make_events):
    events = make_events(
        *walk(12, 1), *walk(3, 2, start=50), event(90, player=2, tags=(101, 401), match=2, at=((5.0, 5.0),)),
        event(91, player=7, team=None),
    )
    players = spark.createDataFrame([(1, 180.0, 75.0)], "wyId long, height double, weight double")
    for skew in ({}, {"hot_rows": 5}):
        wide = jobs.player_features(events, players, **skew)
        assert wide.columns == GROUP + fixed.FEATURES and len(fixed.FEATURES) == 54
        got = by_key(wide, *GROUP)
        assert set(got) == {(1, "1H", 1), (1, "1H", 2), (2, "1H", 2), (1, "1H", 7)}
        assert got[(1, "1H", 1)]["height"] == 180.0 and got[(1, "1H", 2)]["height"] is None
        assert got[(1, "1H", 2)]["gol"] == got[(2, "1H", 2)]["gol"] == 0.5
        assert got[(2, "1H", 2)]["ambidestro"] == 1.0 and got[(2, "1H", 2)]["total_distance"] == 0.0
        assert got[(1, "1H", 7)]["pass_simple_pct_WRT"] is None and got[(1, "1H", 7)]["posizione_media_x"] == 50.0


def test_hot_path_does_not_sort_a_whole_group_in_one_task(make_events):
    events = make_events(*walk(200, 1, same_time=True))
    ordered = events.select(*GROUP, *motion.ORDER).repartitionByRange(8, *GROUP, *motion.ORDER)
    from pyspark.sql import functions as F

    pieces = ordered.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in pieces) < 100
