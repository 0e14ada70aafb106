"""Every registered query runs; where it has SQL, the rows are the same."""

import pytest

from gridsight.queries import QUERIES, SQL
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, folder, con, name):
    verdict, note = compare(QUERIES[name](spark, folder), con, SQL[name])
    assert verdict in ("ok", "close"), note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
