"""Queries with SQL, on the test tables."""

import pytest

from lithos.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA
from tests.oracle import connect, same

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, SF), connect(SF), ORACLES[name])
