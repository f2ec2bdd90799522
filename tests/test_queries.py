"""Every registered query of the memory engine against DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest

from compare import duckdb_rows, spark_rows
from recallgrid.plans import registry

QUERIES, SQL = registry.queries(), registry.sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duckdb_rows(SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "content", "event_date", "confidence", "origin_agent", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
