"""JSON arrays by byte ranges of any size against the whole file."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldline.sources import json_arrays, readers

WORDS = ["", "}", "{", "[{", '"', "\\", '\\"', "a\nb", "}}]", "é😀中", "\\}", "x" * 40, ",", " ", "{\"a\": 1}"]


def records(seed, many):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choice(WORDS) for _ in range(draw.randrange(4)))
    return [
        {"id": k, "name": text(), "in": {"t": text(), "n": [draw.randrange(9) for _ in range(draw.randrange(3))]}, "tags": [{"id": draw.randrange(5)} for _ in range(draw.randrange(3))], text() + "key": text()}
        for k in range(many)
    ]


@pytest.fixture
def split(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("size", [23, 64, 301, 4_000, 1 << 20])
def test_any_range_gives_the_records_of_the_whole_file(spark, tmp_path, split, size):
    want = []
    for name, many, layout in (("a", 40, {}), ("b", 25, {"indent": 2}), ("c", 30, {"ensure_ascii": False, "separators": (",", ":")}), ("d", 1, {}), ("e", 0, {})):
        rows = records(name, many)
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, **layout), encoding="utf-8")
        want += rows
    (tmp_path / "f.json").write_text(' \n[ {"id": 1}\n\n, {"id": {"id": 2}} ]\n\n')
    (tmp_path / "g.json").write_text('["{", 5, {"id": 3}, null, [4], {}]')
    (tmp_path / "h.json").write_text('{"id": 9}')
    want += [{"id": 1}, {"id": {"id": 2}}, {"id": 3}, {}, {"id": 9}]
    split(size)
    got = [json.loads(r["value"]) for r in json_arrays.read_records(spark, str(tmp_path)).collect()]
    key = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_a_record_may_span_many_ranges(spark, tmp_path, split):
    rows = [{"id": 1}, {"id": 2, "deep": [{"x": {"y": "}" * 300}} for _ in range(50)]}, {"id": 3}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    split(100)
    got = [json.loads(r["value"]) for r in json_arrays.read_records(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r["id"]) == rows


def test_ranges_are_tasks_of_their_own(spark, tmp_path, split):
    (tmp_path / "a.json").write_text(json.dumps(records(1, 300)))
    split(2_000)
    assert json_arrays._fragments(spark, str(tmp_path)).rdd.getNumPartitions() > 5


def test_arrays_come_back(spark, tmp_path):
    schema = T.StructType.fromDDL("id long, name string, in struct<t: string, n: array<long>>")
    rows = [(k, WORDS[k % len(WORDS)], (WORDS[-k % len(WORDS)], [k, k + 1])) for k in range(50)]
    df = spark.createDataFrame(rows, schema).repartition(6)
    json_arrays.write_arrays(df, str(tmp_path / "out"))
    for part in (tmp_path / "out").glob("part-*"):
        json.loads(part.read_text())
    assert sorted(json_arrays.read_array(spark, str(tmp_path / "out"), schema).collect()) == sorted(df.collect())
    json_arrays.write_arrays(df.filter("id < 0"), str(tmp_path / "none"))
    assert json_arrays.read_array(spark, str(tmp_path / "none"), schema).count() == 0


def test_a_record_that_does_not_fit_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "word"}]')
    with pytest.raises(Exception, match="MALFORMED"):
        json_arrays.read_array(spark, str(tmp_path), T.StructType.fromDDL("id long")).collect()


def test_event_log_as_array(spark, tmp_path, split):
    rows = [{"id": k, "playerId": 1, "matchId": 2, "matchPeriod": "1H", "teamId": 3, "eventId": 8, "subEventId": 85 if k else "", "eventName": "}{", "eventSec": k / 3,
             "tags": [{"id": 1801}], "positions": [{"y": 50, "x": k}]} for k in range(60)]
    (tmp_path / "events.json").write_text(json.dumps(rows))
    whole = readers.read_events(spark, str(tmp_path), layout="array").orderBy("id").collect()
    assert [r["x"] for r in whole] == [float(k) for k in range(60)] and whole[0]["subEventId"] == readers.NO_SUBTYPE
    split(500)
    assert readers.read_events(spark, str(tmp_path), layout="array").orderBy("id").collect() == whole
    lines = spark.read.schema("value string").text(str(tmp_path))
    assert lines.select(F.count("*")).first()[0] == 1


def test_small_ranges_share_tasks(spark, tmp_path, split):
    rows = records(3, 3_000)
    (tmp_path / "a.json").write_text(json.dumps(rows))
    with json_arrays.ranges_of(spark, str(tmp_path), "1000") as tasks:
        assert tasks == 4 * spark.sparkContext.defaultParallelism
        fragments = json_arrays._fragments(spark, str(tmp_path))
        assert fragments.select("start").distinct().count() > 5 * tasks
        assert fragments.rdd.getNumPartitions() <= tasks + 1
        got = [json.loads(r["value"]) for r in json_arrays.read_records(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r["id"]) == rows
    assert spark.conf.get("spark.sql.files.maxPartitionNum", None) is None


def test_one_file_written_from_many_tasks(spark, tmp_path):
    df = spark.range(0, 25_000, numPartitions=6).select("id", F.concat(F.lit("}],é"), "id").alias("t"))
    json_arrays.write_arrays(df, str(tmp_path / "one"), files=1)
    (only,) = (tmp_path / "one").glob("part-*")
    assert sorted((r["id"], r["t"]) for r in json.loads(only.read_text())) == [(i, f"}}],é{i}") for i in range(25_000)]
    json_arrays.write_arrays(df.filter("id < 0"), str(tmp_path / "none"), files=1)
    (only,) = (tmp_path / "none").glob("part-*")
    assert json.loads(only.read_text()) == []
