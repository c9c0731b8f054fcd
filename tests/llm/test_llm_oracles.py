"""The training-data queries that have SQL equal it on the smallest tables."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
pytest.importorskip("matchloom.llm")

from check import TABLES, difference  # noqa: E402
from matchloom.llm.queries import ORACLES, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    base = duckdb.connect()
    for table in TABLES:
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{Path(FOLDER) / (table + '.parquet')}'")
    assert difference(QUERIES[name](spark, FOLDER).toPandas(), base.execute(ORACLES[name]).df()) is None


def test_queries_without_sql_return_a_row_per_document(spark):
    count = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op3_token_files", "op6_byte_bpe", "op9_toxicity", "op10_pitman_yor"):
        assert QUERIES[name](spark, FOLDER).count() == count
