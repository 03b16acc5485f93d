"""Every registered query of the engine against its SQL."""

import pytest

from lithos.oracles import ORACLES
from lithos.queries import QUERIES
from tests.conftest import DATA
from tests.oracle import connect, same

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["filter_eq"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan
    assert "o_orderkey" in plan and "o_totalprice" not in plan
