"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle_check import compare, connect

from vacantia.catalog.registry import ORACLES, QUERIES, load_all

load_all()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    message, _ = compare(QUERIES[name](spark, sf), duck, ORACLES[name])
    assert not message


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
