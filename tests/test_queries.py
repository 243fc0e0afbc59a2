"""Every query of the core against its SQL, on the smallest tables."""

import pytest
from compare import connect, same

from quartzfold.plans import files, library, quality, structures

SF = "/root/testdata/sf0.001"
QUERIES = {**library.QUERIES, **structures.QUERIES, **files.QUERIES, **quality.QUERIES}
SQL = {**library.SQL, **structures.SQL, **files.SQL, **quality.SQL}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_core_alone(monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "quartzfold.llm.queries", None)  # as if what it needs weren't there
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
