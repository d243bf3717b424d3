import pytest

from changeloom.plans.catalog import ORACLES, QUERIES

from .oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    compare(spark, con, QUERIES[name], ORACLES[name], FOLDER)


def test_entry_point_imports():
    import __spark_entry__

    assert set(ORACLES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
