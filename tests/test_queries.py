import os

import pytest

from cellarium.plans.queries import QUERIES, SQL
from tests.oracle import connect, same

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows_as_sql(spark, duck, name):
    same(QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).fetchdf())


def test_every_query_but_hashes_has_sql():
    assert set(QUERIES) - set(SQL) == {"murmur_hash_keys"}


def test_key_predicates_reach_the_scan(spark):
    plan = QUERIES["get_row"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "lpad" in plan.split("Exchange")[-1]  # the filter stands below the only exchange
    assert plan.count("Exchange hashpartitioning") == 1
