import pytest

from slipweave.plans.queries import ORACLE, QUERIES
from tests.oracle import same

SF = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_duckdb(spark, name):
    same(spark, name, QUERIES[name], ORACLE[name], SF)
