"""Every query with SQL gives the rows that DuckDB gives; the others run."""

from __future__ import annotations

import pytest

from sitewright import queries
from tests.compare import duck_rows, spark_rows

queries.load()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    columns, rows = spark_rows(queries.QUERIES[name](spark, sf))
    want_columns, want = duck_rows(queries.ORACLE_SQL[name], sf)
    assert columns == want_columns
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - {"match_percentiles"}))
def test_other_queries_run(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
