import os

import pytest

from strata.llm import queries
from tests.oracle import SMALL, connect, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(queries.queries()[name](spark, SMALL), connect(SMALL), queries.oracle_sql()[name])


def test_canonical_query_answers_every_value(spark):
    found = queries.p3_found(spark, SMALL)
    assert found.count() == found.select("src", "rec_id").distinct().count() > 0
