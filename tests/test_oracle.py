"""Every registered query against its SQL on the smallest tables; those of the optional subpackage have tests of their own."""

import re

import compare
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
    else:
        assert compare.differences(got, duck.sql(sql).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
