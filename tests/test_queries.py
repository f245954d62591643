"""Every registered query on the smallest tables, against its SQL where it has one."""

import pytest

from compare import connect, difference
from replylens.plans import load_all
from replylens.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
load_all()
# Queries that rightly find nothing in the smallest tables.
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert difference(spark, con, SF, QUERIES[name], SQL[name]) == ("no rows" if name in EMPTY else None)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
