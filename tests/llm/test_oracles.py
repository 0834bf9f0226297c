"""The queries that SQL can express, against it."""

import compare
import pytest

from linkfold.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert compare.differences(got, compare.duck(SF).sql(queries.ORACLES[name]).df()) is None
