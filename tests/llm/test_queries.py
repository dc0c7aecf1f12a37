import pytest

from textloom.llm import queries as Q

from ..oracle import compare


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_against_sql(spark, name):
    compare(spark, Q.QUERIES[name], Q.ORACLE_SQL[name])


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in Q.QUERIES if n.startswith("op")] == [f"op{i}" for i in range(1, 11)] and "pipeline" in Q.QUERIES
