"""Driver contract: entry() runs, every query has a stable schema on the
smallest data, and oracle names are a subset of query names."""

import pytest

import __spark_entry__ as E


def test_entry_returns_rows(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"request_id", "position", "id", "name", "artists"} <= set(df.columns)


def test_oracles_name_registered_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 50


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_every_query_runs_on_small_data(spark, sf_small, name):
    df = E.queries()[name](spark, sf_small)
    assert df.columns == df.columns  # schema resolves
    df.limit(5).collect()
