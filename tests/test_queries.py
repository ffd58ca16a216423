"""Every registered query of the library against its SQL."""

import pytest

from larkspur import registry
from tests.oracle import connect, rows_of, rows_of_sql


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, sf_dir, con, name):
    got, expected = rows_of(registry.QUERIES[name](spark, sf_dir)), rows_of_sql(con, registry.ORACLE_SQL[name])
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1]) and got[1] == expected[1]


def test_every_query_is_compared():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == set()


def test_random_examples_repeat(spark, sf_dir):
    first, again = (sorted(r["number"] for r in registry.QUERIES["fewshot_random"](spark, sf_dir).collect()) for _ in range(2))
    assert first == again and len(set(first)) == 5
