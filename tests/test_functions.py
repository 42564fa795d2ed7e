import math

import pytest
from conftest import by_key, event
from pyspark.sql import functions as F

from fieldline import fixed
from fieldline.functions import events as ev
from fieldline.functions.vectors import cells_from, cosine, euclidean, least_kept, nearest, pick_label


@pytest.mark.parametrize(
    ("value", "cell"),
    [(None, 0), (0.0, 0), (0.5, 0), (20.0, 0), (20.1, 1), (40.0, 1), (60.1, 3), (100.0, 4), (101.0, 0), (-1.0, 0)],
)
def test_grid_cell_bins_are_closed_on_the_right(spark, value, cell):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(ev.grid_cell(F.col("v"))).first()[0] == cell


def test_normalised_events(make_events):
    got = by_key(
        make_events(
            event(1, tags=(101, 1801), at=((10.0, 30.0), (20.0, 40.0))),
            event(2, tags=None, at=None),
            event(3, tags=(), at=((7.0, 100.0),), sub=""),
            event(4, at=((float("nan"), 3.0),), sub="what"),
        ),
        "id",
    )
    assert got[1]["tags"] == [101, 1801] and got[2]["tags"] == [] and got[3]["tags"] == []
    assert (got[1]["x"], got[1]["y"], got[1]["x_end"], got[1]["y_end"]) == (10.0, 30.0, 20.0, 40.0)
    assert got[1]["has_doublepos"] and not got[2]["has_doublepos"] and not got[3]["has_doublepos"]
    assert got[2]["x"] is None and got[3]["x_end"] is None and got[4]["x"] is None
    assert (got[3]["numero_cella_x"], got[3]["numero_cella_y"]) == (0, 4)
    assert (got[2]["numero_cella_x"], got[4]["numero_cella_x"]) == (0, 0)
    assert got[3]["subEventId"] == -1 and got[4]["subEventId"] is None and got[1]["subEventId"] == 85
    assert got[1]["angle"] == pytest.approx(math.pi / 4) and got[3]["angle"] is None


@pytest.mark.parametrize(
    ("dx", "dy", "angle"),
    [
        (0, 0, math.pi / 2), (1, 0, 0), (0, 1, math.pi / 2), (-1, 0, math.pi), (0, -1, 3 * math.pi / 2),
        (1, 1, math.pi / 4), (-1, 1, 3 * math.pi / 4), (-1, -1, 5 * math.pi / 4), (1, -1, 7 * math.pi / 4),
    ],
)
def test_move_angle_covers_the_circle(spark, dx, dy, angle):
    df = spark.createDataFrame([(50.0, 50.0, 50.0 + dx, 50.0 + dy)], "a double, b double, c double, d double")
    assert df.select(ev.move_angle(*[F.col(c) for c in "abcd"])).first()[0] == pytest.approx(angle)


def test_padded_positions(spark):
    from fieldline.schema import event_schema

    rows = [event(1, at=((1.0, 2.0),)), event(2, at=((1.0, 2.0), (3.0, 4.0)))]
    df = spark.createDataFrame(rows, event_schema()).select("id", ev.padded_positions().alias("p"))
    got = {r["id"]: [(p["x"], p["y"]) for p in r["p"]] for r in df.collect()}
    assert got == {1: [(1.0, 2.0), (1.0, 2.0)], 2: [(1.0, 2.0), (3.0, 4.0)]}


def test_select_event_needs_type_and_subtype_even_when_free(make_events):
    events = make_events(
        event(1, kind=8, sub="80", tags=(1801,)),
        event(2, kind=8, sub="85"),
        event(3, kind=None, sub="85", tags=(1801,)),
        event(4, kind=8, sub=None, tags=(1801,)),
        event(5, kind=8, sub="", tags=(1801,)),
        event(6, kind=10, sub="100", tags=(1801,)),
    )

    def ids(*spec):
        return {r["id"] for r in events.filter(ev.select_event(*spec)).collect()}

    assert ids(None, None, 1801) == {1, 5, 6}
    assert ids(8, None, None) == {1, 2, 5}
    assert ids(8, 80, 1801) == {1}
    assert ids() == {1, 2, 5, 6}


def test_home_name_and_alias(spark):
    df = spark.createDataFrame([("Juventus - Roma, 1 - 0",), ("Hellas Verona - Roma, 0 - 0",)], "label string")
    assert [r[0] for r in df.select(ev.home_name(F.col("label"))).collect()] == ["Juventus", "Hellas Verona"]


def test_sides_are_turned(spark):
    rows = [(30.0, 1, 1, "1H"), (30.0, 1, 1, "2H"), (30.0, 2, 1, "1H"), (30.0, 2, 1, "2H"), (30.0, 2, None, "1H")]
    df = spark.createDataFrame(rows, "v double, team long, home long, period string")
    got = [r[0] for r in df.select(ev.attack_left_to_right(*[F.col(c) for c in ("v", "team", "home", "period")])).collect()]
    assert got == [30.0, 70.0, 70.0, 30.0, 70.0]


def test_dominant_names_the_larger_and_ties(spark):
    df = spark.createDataFrame([(2.0, 1.0), (1.0, 2.0), (1.0, 1.0)], "a double, b double")
    args = (F.col("a"), F.col("b"), F.lit("A"), F.lit("B"))
    assert [r[0] for r in df.select(ev.dominant(*args)).collect()] == ["A", "B", None]
    assert [r[0] for r in df.select(ev.dominant(*args, F.lit("Tied"))).collect()] == ["A", "B", "Tied"]


def test_top_cells_prefer_the_later_cell_on_ties(spark):
    counts = [0.0] * 25
    for i, v in {3: 5.0, 7: 2.0, 9: 2.0, 20: 2.0}.items():
        counts[i] = v
    df = spark.createDataFrame([tuple(counts)], ", ".join(f"`{c}` double" for c in fixed.CELLS))
    row = df.withColumn("_least", least_kept()).select(*cells_from("_least")).first()
    assert {i: v for i, v in enumerate(row) if v} == {3: 5.0, 9: 2.0, 20: 2.0}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    row = df.select(
        cosine(F.col("a"), F.col("b")), euclidean(F.col("a"), F.col("b")), cosine(F.col("a"), F.col("z"))
    ).first()
    assert row[0] == pytest.approx(24 / 25) and row[1] == pytest.approx(math.sqrt(2)) and row[2] is None
    near = df.select(nearest(F.col("a"), [[0.0, 0.0], [3.0, 5.0], [3.0, 3.0]]).alias("n")).first()["n"]
    assert (near["d"], near["i"]) == (1.0, 1)  # equal distances: the lower index
    assert df.select(pick_label(F.lit(1), ["x", "y"])).first()[0] == "y"
