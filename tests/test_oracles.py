"""Every query gives the same rows as its SQL."""

import pytest

import compare
from catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    assert compare.differences(spark, con, name, FOLDER, QUERIES, ORACLES) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
