"""Every query with SQL gives what DuckDB gives; the others run."""

import pytest
from compare import of_duckdb, of_spark

from relaypack.plans import reference_queries as rq


@pytest.mark.parametrize("name", sorted(rq.SQL))
def test_equals_sql(spark, sf_dir, name):
    assert of_spark(rq.QUERIES[name](spark, sf_dir)) == of_duckdb(rq.SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(rq.CASES))
def test_cases_equal_sql(spark, sf_dir, name):
    assert of_spark(rq.CASES[name](spark, sf_dir)) == of_duckdb(rq.CASE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(rq.QUERIES) - set(rq.SQL)))
def test_runs(spark, sf_dir, name):
    assert rq.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
