"""Queries of the training-data operators on the smallest tables."""

import pytest
from compare import connect, same

from quartzfold.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, name):
    same(QUERIES[name](spark, SF), connect(SF), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
