"""Every query of the subpackage runs on the smallest tables; those with SQL give the same rows in DuckDB."""

import pytest

from millrace.llm.queries import QUERIES, SQL
from tests.oracle import assert_same, connection


@pytest.fixture(scope="module")
def duck(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    got = QUERIES[name](spark, small).toPandas()
    if name in SQL:
        assert_same(got, duck.sql(SQL[name]).df())
