"""Exact quantiles against NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldline.operators import quantiles


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    out = [(draw.choice(["a", "b", None]), draw.gauss(0, 10)) for _ in range(900)]
    out += [("a", 3.0)] * 500  # a value that a third of the rows share
    out += [("one", 7.5), ("two", 1.0), ("two", 2.0), ("none", None), ("nan", float("nan")), ("b", None)]
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles_equal_numpy(spark, rows, parts):
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    df = spark.createDataFrame(rows, "g string, v double").repartition(parts)
    got = {(r["g"], r["q"]): (r["n"], r["v"]) for r in quantiles.quantiles(df, "v", shares, ["g"]).collect()}
    groups = {}
    for g, v in rows:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    assert set(got) == {(g, q) for g in groups for q in shares}
    for (g, q), (n, v) in got.items():
        assert n == len(groups[g]) and v == pytest.approx(np.quantile(groups[g], q), abs=1e-12)


def test_quantiles_of_a_whole_table(spark, rows):
    values = [v for _, v in rows if v is not None and v == v]
    df = spark.createDataFrame(rows, "g string, v double")
    found = quantiles.quantiles(df, "v", [0.75]).collect()
    assert len(found) == 1 and found[0]["v"] == pytest.approx(np.quantile(values, 0.75))
    above = [r["v"] for r in quantiles.above_quantile(df, "v", 0.75).collect()]
    assert sorted(v for v in above if v == v) == sorted(v for v in values if v > np.quantile(values, 0.75))
    assert quantiles.quantiles(df.filter("g = 'none'"), "v", [0.5]).collect() == []
    with pytest.raises(ValueError, match="between"):
        quantiles.quantiles(df, "v", [1.5])


def test_above_the_quantile_of_the_own_group(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[1] is None or r[1] == r[1]], "g string, v double")
    got = sorted(((r["g"] or "", r["v"]) for r in quantiles.above_quantile(df, "v", 0.5, ["g"]).collect()))
    groups = {}
    for g, v in rows:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    assert got == sorted((g or "", v) for g, own in groups.items() for v in own if v > np.quantile(own, 0.5))


def test_no_task_holds_all_values(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    df = spark.range(20_000).select(F.lit("a").alias("g"), F.rand(3).alias("v"))
    sizes = quantiles.ranged_counts(df, "v", ["g"]).groupBy("_piece").count().collect()
    assert len(sizes) > 2 and max(r["count"] for r in sizes) < 12_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
