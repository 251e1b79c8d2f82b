import pytest
from oracle import assert_agrees

import __spark_entry__
from scoreframe import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_agrees_with_sql(spark, name):
    assert_agrees(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
