import pytest
from oracle import differences

from tidewake import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert differences(df, catalogue.ORACLES[name], SF)[:3] == []
