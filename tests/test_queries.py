"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import connect, differences
from checks.registry import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    problem, _ = differences(QUERIES[name](spark, SF_DIR), duck, ORACLES[name])
    assert not problem


def test_flagship(spark):
    counts = {r["type"]: r["count"] for r in entry.entry(spark).groupBy("type").agg({"count": "sum"}).toDF("type", "count").collect()}
    assert counts["File"] == 200
