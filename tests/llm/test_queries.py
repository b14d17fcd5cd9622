import pytest

from slipweave.llm.queries import ORACLE, QUERIES
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_duckdb(spark, name):
    same(spark, name, QUERIES[name], ORACLE[name], SF)
