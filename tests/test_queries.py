"""Every registered query of the library against its SQL twin."""

import pytest
from oracle import compare

import __spark_entry__ as entry
from fleetwitness.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_the_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "status" in df.columns


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    problem, rows = compare(entry.queries()[name](spark, SF), SF, entry.oracle_sql()[name])
    assert problem is None, problem
    assert rows > 0
