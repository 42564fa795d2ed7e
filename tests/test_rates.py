import pytest
from conftest import by_key, event

from fieldline import fixed
from fieldline.operators import rates
from fieldline.plans import jobs
from fieldline.schema import GROUP, EventSpec

SHOT = next(s for s in fixed.SHARE_SPECS if s.name == "shot")
PASS = next(s for s in fixed.SHARE_SPECS if s.name == "accurate_pass")


def shot(id, **kw):
    return event(id, kind=10, sub="100", name="Shot", **kw)


def test_shares_of_team_add_up_to_one(make_events):
    events = make_events(
        *[shot(i, player=1) for i in range(3)], shot(10, player=2), shot(11, player=3, team=20),
        event(12, player=4), shot(13, player=1, period="2H"),
    )
    got = by_key(rates.share_of_team(events, SHOT), *GROUP, "teamId")
    assert {k: v["shot_pct_WRT"] for k, v in got.items()} == {
        (1, "1H", 1, 10): 0.75, (1, "1H", 2, 10): 0.25, (1, "1H", 3, 20): 1.0, (1, "2H", 1, 10): 1.0,
    }


def test_share_of_own_events(make_events):
    events = make_events(
        event(1, tags=(1801,)), event(2), event(3), shot(4, tags=(1801,)), event(5, player=2),
    )
    got = by_key(rates.share_of_player(events, PASS), *GROUP)
    assert got == {(1, "1H", 1): {"teamId": 10, "accurate_pass_pct_WRP": 0.25}}


def test_all_shares_in_one_row(make_events):
    events = make_events(
        event(1, tags=(1801,)), event(2, kind=2, sub="20"), event(3, player=2, kind=2, sub="20"),
        event(4, player=3, kind=99, sub="1"),
    )
    got = by_key(rates.event_shares(events), *GROUP)
    assert set(got) == {(1, "1H", 1), (1, "1H", 2)}  # player 3 has none of the kinds
    assert got[(1, "1H", 1)]["foul_pct_WRT_x"] == got[(1, "1H", 1)]["foul_pct_WRT_y"] == 0.5
    assert got[(1, "1H", 1)]["accurate_pass_pct_WRP"] == 0.5
    assert got[(1, "1H", 1)]["shot_pct_WRT"] is None
    assert list(got[(1, "1H", 1)]) == [
        n for s in fixed.SHARE_SPECS for n in (fixed.FOUL_SHARE_NAMES if s.name == "foul" else [s.share_column])
    ]


def test_a_player_of_both_teams_has_one_row(make_events):
    events = make_events(
        event(1, player=0, kind=1, sub="10"), event(2, player=0, team=20, kind=1, sub="10"),
        event(3, player=5, team=20, kind=1, sub="10"), event(4, player=6, kind=1, sub="10"),
    )
    got = by_key(rates.event_shares(events), *GROUP)
    assert got[(1, "1H", 0)]["duel_pct_WRT"] == 2 / 4


def test_rows_without_a_key_are_left_out(make_events):
    events = make_events(shot(1, player=None), shot(2, team=None), shot(3))
    assert list(by_key(rates.share_of_team(events, SHOT), *GROUP)) == [(1, "1H", 1)]


def test_season_means(make_events):
    events = make_events(
        event(1, match=1, tags=(101,)), event(2, match=1, tags=(101, 301)), event(3, match=2),
        event(4, match=3, player=2),
    )
    got = by_key(rates.season_means(events), "playerId")
    assert got[1] == {"assist": 0.5, "gol": 1.0, "yellow_card": None}
    assert got[2] == {"assist": None, "gol": None, "yellow_card": None}


def test_foot_balance(make_events):
    events = make_events(
        *[event(i, tags=(401,)) for i in range(3)], event(5, tags=(402,)), event(6, player=2, tags=(402,)),
        event(7, player=3),
    )
    assert by_key(rates.foot_balance(events), "playerId") == {1: {"ambidestro": 0.5}, 2: {"ambidestro": 1.0}}


def test_two_position_share(make_events):
    two = ((1.0, 1.0), (2.0, 2.0))
    events = make_events(event(1, at=two), event(2), event(3), event(4, at=two), event(5, name="Foul"))
    got = by_key(rates.two_position_share(events), "eventName")
    assert got == {"Pass": {"two_position_pct": 50.0}, "Foul": {"two_position_pct": 0.0}}


def test_pass_accuracy_leaves_out_players_without_an_accurate_pass(make_events):
    events = make_events(
        event(1, player=1, tags=(1801,)), event(2, player=1), event(3, player=2, tags=(1801,)),
        event(4, player=3), event(5, player=9, team=20, tags=(1801,)),
    )
    team, mean, spread = fixed.ACCURACY_COLUMNS
    got = by_key(jobs.pass_accuracy(events), team)
    assert got[10] == {mean: 0.75, spread: 0.35} and got[20] == {mean: 1.0, spread: None}


def test_rounding_is_half_even(make_events):
    # 1 of 8 accurate is 0.125, which becomes 0.12
    events = make_events(event(0, tags=(1801,)), *[event(i) for i in range(1, 8)])
    assert jobs.pass_accuracy(events).first()[fixed.ACCURACY_COLUMNS[1]] == 0.12


def test_top_tacklers_are_strictly_above_the_quantile(spark, make_events):
    wins = {1: 1, 2: 1, 3: 2, 4: 4, 5: 7}
    rows = [
        event(100 * p + i, player=p, kind=1, sub="12", tags=(703,)) for p, n in wins.items() for i in range(n)
    ] + [event(900 + i, player=6, kind=1, sub="12") for i in range(9)]
    names = spark.createDataFrame([(p, f"P{p}") for p in (4, 5)], "playerId long, name string")
    got = jobs.top_tacklers(make_events(*rows), names).collect()
    assert [tuple(r) for r in got] == [(5, "P5", 7)]  # quantile of 1 1 2 4 7 is 4
    counts = by_key(rates.tackles_by_player(make_events(*rows)), "playerId")
    assert counts[6] == {"n_tackles": 9, "n_tackles_won": 0}


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0])
def test_count_quantile_interpolates(spark, q):
    import numpy as np

    values = [1, 1, 1, 2, 5, 5, 9, 12]
    df = spark.createDataFrame([(v,) for v in values] + [(0,)], "n long")
    got = spark.range(1).select(rates.count_quantile(df, "n", q).alias("q")).first()["q"]
    assert got == pytest.approx(np.quantile(values, q))


def test_appearances(make_events):
    events = make_events(event(1, match=1), event(2, match=1), event(3, match=2), event(4, player=2))
    assert by_key(rates.appearances(events), "playerId") == {1: {"numero_presenze": 2}, 2: {"numero_presenze": 1}}


def test_spec_columns():
    assert EventSpec("a").share_column == "a_pct_WRT" and EventSpec("a", share_of="player").share_column == "a_pct_WRP"
