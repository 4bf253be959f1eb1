"""Every portable query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tidemark import registry
from tidemark.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def _shown(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    ours = registry.queries()[name](spark, SF)
    columns = sorted(ours.columns)
    found = sorted(tuple(_shown(row[c]) for c in columns) for row in ours.collect())
    other = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in other.description]
    assert sorted(names) == columns
    assert found == sorted(tuple(_shown(dict(zip(names, row))[c]) for c in columns) for row in other.fetchall())
