"""Every query of the core runs on the smallest tables; those with SQL give the same rows in DuckDB."""

import pytest

from millrace.plans import classes, code, files, general, general_sql, series, waves
from tests.oracle import assert_same, connection

CATALOGUES = [series.C, classes.C, code.C, waves.C, files.C]
QUERIES = dict(general.QUERIES)
SQL = dict(general_sql.SQL)
for c in CATALOGUES:
    QUERIES |= c.queries
    SQL |= c.sql


@pytest.fixture(scope="module")
def duck(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    got = QUERIES[name](spark, small).toPandas()
    if name in SQL:
        assert_same(got, duck.sql(SQL[name]).df())


def test_entry_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
