"""Every registered query with an oracle matches DuckDB on the sf0.001 tables."""

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare

NAMES = sorted(E.oracle_sql().keys())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_small, name):
    n_spark, n_oracle, same = compare(spark, sf_small, name)
    assert n_spark == n_oracle
    assert same


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "matched_hour_count" in df.columns


def test_every_query_has_a_builder():
    assert set(E.oracle_sql()) <= set(E.queries())
