"""The queries that SQL can state, against DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

from plenum.llm import queries
from tests.test_queries import DATA, _rows

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    found, told = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(told.columns)
    assert _rows(found) == _rows(told)
