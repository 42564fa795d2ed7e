import json

import pytest
from conftest import by_key, event
from pyspark.sql import types as T

from fieldline.operators import tables
from fieldline.plans import jobs
from fieldline.schema import event_schema
from fieldline.session import materialise, shared_folder
from fieldline.sources import readers
from fieldline.sources.writers import write_csv, write_events, write_parquet

RAW = {
    "id": 7, "playerId": 3, "matchPeriod": "1H", "teamId": "France", "eventId": 8, "subEventId": "", "eventName": "Pass",
    "eventSec": 1.5, "tags": [{"id": 1801}], "positions": [{"y": 10, "x": 90}, {"y": 12, "x": 80}], "unused": 1,
}


def test_single_match_json_with_team_names(spark, tmp_path):
    path = tmp_path / "cup.json"
    path.write_text(json.dumps([RAW, {**RAW, "id": 8, "subEventId": 12}]))
    got = by_key(readers.read_events(spark, str(path), layout="array", team_type=T.StringType(), match_id=1), "id")
    assert got[7]["teamId"] == "France" and got[7]["matchId"] == 1 and got[7]["tags"] == [1801]
    assert got[7]["subEventId"] == -1 and got[8]["subEventId"] == 12
    assert (got[7]["x"], got[7]["y"], got[7]["x_end"]) == (90.0, 10.0, 80.0)


def test_json_lines_and_parquet_events(spark, tmp_path):
    rows = [{**RAW, "teamId": 4, "matchId": 2, "id": i} for i in range(3)]
    lines = tmp_path / "events.jsonl"
    lines.write_text("\n".join(json.dumps(r) for r in rows))
    from_lines = readers.read_events(spark, str(lines))
    assert sorted(r["id"] for r in from_lines.collect()) == [0, 1, 2]
    raw = spark.createDataFrame([event(1), event(2, period="2H")], event_schema())
    write_events(raw, str(tmp_path / "events.parquet"))
    again = readers.read_events(spark, str(tmp_path / "events.parquet"), fmt="parquet")
    assert {(r["id"], r["matchPeriod"]) for r in again.collect()} == {(1, "1H"), (2, "2H")}
    with pytest.raises(ValueError):
        readers.read_events(spark, "x", fmt="orc")


def test_dimension_files(spark, tmp_path):
    (tmp_path / "players.json").write_text(
        json.dumps([{"wyId": 5, "shortName": "A. B", "lastName": "B", "height": 180, "weight": 70, "currentTeamId": 1,
                     "role": {"code2": "DF", "code3": "DEF"}}])
    )
    player = readers.read_players(spark, str(tmp_path / "players.json")).first()
    assert (player["wyId"], player["role"]["code2"], player["height"]) == (5, "DF", 180.0)
    (tmp_path / "teams.json").write_text(json.dumps([{"wyId": 1, "name": "X", "officialName": "X FC"}]))
    assert readers.read_teams(spark, str(tmp_path / "teams.json")).first()["officialName"] == "X FC"
    (tmp_path / "matches.json").write_text(json.dumps([{"wyId": 9, "label": "X - Y, 1 - 0"}]))
    assert readers.read_matches(spark, str(tmp_path / "matches.json")).first()["label"].startswith("X ")
    (tmp_path / "names.json").write_text(json.dumps([{"playerId": 5, "name": "Š. V"}]))
    assert readers.read_player_names(spark, str(tmp_path / "names.json")).first()["name"] == "Š. V"


def test_feature_csv_drops_the_index(spark, tmp_path):
    path = tmp_path / "dataset.csv"
    path.write_text(",matchId,playerId,matchPeriod,gol,00\n0,1,5.0,1H,0.25,3\n1,1,,2H,,\n")
    got = readers.read_feature_csv(spark, str(path))
    assert got.columns == ["matchId", "playerId", "matchPeriod", "gol", "00"]
    rows = {r["matchPeriod"]: r for r in got.collect()}
    assert rows["1H"]["playerId"] == 5 and rows["1H"]["gol"] == 0.25 and rows["1H"]["00"] == 3.0
    assert rows["2H"]["playerId"] is None and rows["2H"]["gol"] is None


def test_measure_folder(spark, tmp_path):
    (tmp_path / "shot.csv").write_text(",matchId,playerId,shot\n0,1,5,0.5\n")
    (tmp_path / "goal_P.csv").write_text(",,0\n0,0.25,5\n1,0.5,6\n")
    (tmp_path / ".hidden.csv").write_text("x\n1\n")
    (tmp_path / "notes.txt").write_text("no table")
    found = readers.read_measure_folder(spark, str(tmp_path))
    assert sorted(found) == ["goal_P", "shot"]
    assert by_key(found["goal_P"], "playerId") == {5: {"goal_P": 0.25}, 6: {"goal_P": 0.5}}
    assert found["shot"].columns == ["matchId", "playerId", "shot"]
    assert list(readers.keyed_on(found, ["matchId", "playerId"])) == ["shot"]


def test_measures_of_a_folder_in_one_scan(spark, tmp_path):
    (tmp_path / "shot.csv").write_text(",matchId,playerId,shot\n0,1,5,0.5\n1,1,6.0,\n2,2,5,0.75\n")
    (tmp_path / "pair.csv").write_text("playerId,duel,matchId,foul\n5,0.1,1,0.2\n7,0.3,1,0.4\n")
    (tmp_path / "goal_P.csv").write_text(",,0\n0,0.25,5\n1,0.5,8\n")
    (tmp_path / "notes.txt").write_text("no table")
    write_csv(spark.createDataFrame([(5, 1.5), (9, 2.5)], "playerId long, foot double").repartition(2), str(tmp_path / "foot.csv"))
    tall, keys_of = readers.read_measures(spark, str(tmp_path))
    assert keys_of == {"shot": ("matchId", "playerId"), "duel": ("matchId", "playerId"), "foul": ("matchId", "playerId"), "goal_P": ("playerId",), "foot": ("playerId",)}
    assert {r["source"] for r in tall.collect()} == {"shot", "pair", "goal_P", "foot"}
    got = by_key(jobs.assemble_folder(spark, str(tmp_path)), "matchId", "playerId")
    empty = dict.fromkeys(["shot", "duel", "foul", "goal_P", "foot"])
    assert got == {
        (1, 5): {"shot": 0.5, "duel": 0.1, "foul": 0.2, "goal_P": 0.25, "foot": 1.5}, (2, 5): empty | {"shot": 0.75, "goal_P": 0.25, "foot": 1.5},
        (1, 6): empty, (1, 7): empty | {"duel": 0.3, "foul": 0.4}, (None, 8): empty | {"goal_P": 0.5}, (None, 9): empty | {"foot": 2.5},
    }


def test_many_measure_files_give_one_scan(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"m{k}.csv").write_text(f",matchId,playerId,m{k}\n0,1,{k % 3},{k}\n")
    tall, keys_of = readers.read_measures(spark, str(tmp_path))
    wide = tables.pivot_measures(tall, ["matchId", "playerId"], sorted(keys_of))
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("Relation [value") == 1
    assert {r["playerId"]: r["m39"] for r in wide.collect()} == {0: 39.0, 1: None, 2: None}


def test_a_key_twice_in_a_measure_file_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("matchId,playerId,a\n1,5,1\n1,5,2\n")
    tall, _ = readers.read_measures(spark, str(tmp_path))
    with pytest.raises(Exception, match="twice"):
        tables.pivot_measures(tall, ["matchId", "playerId"], ["a"]).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert {(r["k"], r["v"]) for r in back.collect()} == {("1", "a"), ("2", None)}
    write_parquet(df, str(tmp_path / "pq"), ["k"])
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_materialise_keeps_rows_and_schema(spark):
    df = spark.range(10).selectExpr("id", "id * 2D AS v")
    stored = materialise(df, "test")
    assert stored.dtypes == df.dtypes and sorted(stored.collect()) == sorted(df.collect())
    assert "Range" not in stored._jdf.queryExecution().toString()
    assert shared_folder(spark)


def test_lines_without_quotation_marks_are_split_at_every_comma(spark, tmp_path):
    (tmp_path / "a.csv").write_text(',playerId,matchId,m\n0, 5 ,7,1.5\n1,6,7,\n2,"8",7,"2.5"\n3,9,"7,1",4\n')
    cells = [r["cells"] for r in readers._measure_lines(spark, str(tmp_path)).filter("NOT is_header").orderBy("cells").collect()]
    assert cells == [["0", "5", "7", "1.5"], ["1", "6", "7", ""], ["2", "8", "7", "2.5"], ["3", "9", "7,1", "4"]]
    plan = readers._measure_lines(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(value#" in plan and ", ,, -1)" in plan
