"""Every registered query of the matching engine equals its DuckDB SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from check import TABLES, difference
from matchloom.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{Path(FOLDER) / (name + '.parquet')}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, base, name):
    assert difference(QUERIES[name](spark, FOLDER).toPandas(), base.execute(ORACLES[name]).df()) is None
