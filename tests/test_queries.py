"""Every registered query against its SQL on the smallest data."""

import os

import pytest

import __spark_entry__ as entry_point
from verification import oracle, queries
from verification.check import differences, expected

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_names_agree():
    assert set(queries.queries()) == set(oracle.oracle_sql())
    assert set(queries.queries()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    got = entry_point.queries()[name](spark, DATA).toPandas()
    spark.catalog.clearCache()
    assert len(got) and not differences(got, expected(DATA, entry_point.oracle_sql()[name]))


def test_entry(spark):
    assert entry_point.entry(spark).count() == 60
