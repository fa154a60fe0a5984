"""Operators that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, compare
from genopair.llm import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, con, sf_dir, name):
    state, _, _, _, note = compare(spark, con, name, sf_dir)
    assert state == "ok", note


def test_operators_and_pipeline_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
