import pytest

from changeloom.llm.oracles import ORACLES
from changeloom.llm.queries import QUERIES

from ..oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, connect(FOLDER), QUERIES[name], ORACLES[name], FOLDER)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
