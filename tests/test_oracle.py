"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import check
from shelfmark import registry

SF = os.environ.get("SHELFMARK_TEST_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.load()  # the training-data queries have tests of their own

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    message, _, ok = check.compare(spark, con, name, SF, QUERIES, ORACLES)
    assert ok, message


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
