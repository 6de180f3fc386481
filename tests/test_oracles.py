"""Each registered query that has SQL against it on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import TABLES, digest

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    frame = queries()[name](spark, SF_DIR)
    result = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    mine = digest([tuple(r) for r in frame.collect()], frame.columns)
    assert mine == digest(result.fetchall(), columns)


def test_entry_returns_rows(spark):
    assert entry(spark).count() > 0
