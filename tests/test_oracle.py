"""Every query with SQL against DuckDB on the smallest tables."""

import pytest

from epiweave.plans import catalog

from .conftest import SF, rows_of


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_queries_without_sql_have_tests_of_their_own():
    import tests.test_models as own

    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == own.COVERED


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
