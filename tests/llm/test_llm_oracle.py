import pytest
from compare import of_duckdb, of_spark

from relaypack.llm import queries


@pytest.mark.parametrize("name", sorted({*queries.SQL, "op9_license_scan"}))
def test_equals_sql(spark, sf_dir, name):
    assert of_spark(queries.QUERIES[name](spark, sf_dir)) == of_duckdb(queries.sql()[name], sf_dir)
