import pytest
from conftest import MEDIUM
from oracle import connect, differences

from plumbline.plans import oracle_sql, queries

@pytest.fixture(scope="module")
def con():
    return connect(MEDIUM)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    result = queries()[name](spark, MEDIUM)
    assert differences(result, con, oracle_sql()[name]) == []


def test_every_query_has_a_twin():
    assert set(queries()) == set(oracle_sql())
