"""The registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, compare
from fieldline.catalog import oracles, queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), oracles.oracle_sql()
# Role models with the published numbers of components, whose projections SQL cannot compute.
WITHOUT_SQL = {"role_clusters", "unknown_role", "seed_check", "role_report"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL and set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    verdict, _ = compare(spark, con, FOLDER, name, QUERIES[name], SQL[name])
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_is_the_grid(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "nome_squadra" and df.count() == 50
