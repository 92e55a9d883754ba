"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tallygrid import file_queries, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["nation", "customer", "part", "orders", "events", "documents", "embeddings"]
QUERIES, SQL = queries.queries() | file_queries.queries(), queries.oracle_sql() | file_queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert {*QUERIES} == {*SQL}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_sql_agrees(spark, duck, name):
    found = QUERIES[name](spark, SF)
    result = duck.execute(SQL[name])
    cols = [d[0] for d in result.description]
    assert sorted(cols) == sorted(found.columns)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in found.collect()))) == sorted(map(repr, result.fetchall()))
