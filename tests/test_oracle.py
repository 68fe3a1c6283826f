"""Every query of the library against its SQL, and those without SQL for their columns."""

import pytest
from oracle import compare, duck

from tablewright.plans import registry

DIR = "/root/testdata/sf0.001"
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, connection, name):
    compare(registry.queries()[name](spark, DIR), connection, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0
