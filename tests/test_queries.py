"""Every named query against its SQL oracle on the small tables."""

import pytest

import __spark_entry__ as contract
from pageloom.plans.oracles import ORACLES
from pageloom.plans.queries import QUERIES
from tests.compare import differences

SF = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_its_oracle(spark, name):
    assert differences(contract.queries()[name](spark, SF), contract.oracle_sql()[name], SF) == []


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["page_id", "row_no", "label", "href", "target"] and df.count() > 0
