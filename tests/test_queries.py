import os

import pytest

from parallaxa.catalog import core
from tests.oracle import DATA, same

REGISTRY = core()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_query_equals_sql(spark, name):
    same(spark, name, REGISTRY.queries[name], REGISTRY.sql[name])


def test_names_and_sql():
    assert set(REGISTRY.sql) <= set(REGISTRY.queries)
    assert set(REGISTRY.queries) == set(REGISTRY.sql)
