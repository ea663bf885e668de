import pytest

from tests.oracle import connection, same
from tidemark.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    return connection(sf)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf, duck, name):
    same(catalogue.QUERIES[name](spark, sf), duck, catalogue.SQL[name])
