"""Every named query against its SQL counterpart."""

import os

import pytest

from __spark_entry__ import entry
from catalog.oracle import ORACLES
from catalog.queries import QUERIES
from tools.compare import connect, differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    rows, problem = differences(spark, duck, FOLDER, name)
    assert problem is None
    # The smallest tables hold few card numbers and toll-free look-alikes.
    assert rows > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    flagship = entry(spark)
    assert len(flagship.columns) == 23 and flagship.count() > 0
