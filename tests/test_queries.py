import pytest
from oracle import connect, differences
from tessella.plans import catalogue, golden, more  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.SQL:
        assert differences(df, con, catalogue.SQL[name]) == []
    else:
        assert df.count() > 0
