"""Every query with SQL against DuckDB on the smallest tables, but for the corpus queries."""

import __spark_entry__ as entry
import pytest

MADE, SQL = entry._own()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(MADE[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(MADE) - set(SQL)))
def test_runs(name, spark):
    """Columns and types; tests/test_query_values.py compares the values."""
    df = MADE[name](spark, "/root/testdata/sf0.001")
    assert len(df.columns) == len(set(df.columns))
    rows = df.collect()
    assert rows and any(v is not None for r in rows for v in r)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_is_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
