import os

import pytest

from strata import registry
from tests.oracle import SMALL, connect, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    same(registry.queries()[name](spark, SMALL), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL) - {"answers"}))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, SMALL)
    assert df.columns and df.count() >= 0
