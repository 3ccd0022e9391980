"""Every core query with SQL gives the rows of its SQL; the others give rows of a stable schema."""

import pytest

from lakesift.plans import registry
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, sf, con, name):
    assert compare(registry.QUERIES[name](spark, sf), con, registry.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns and df.schema == registry.QUERIES[name](spark, sf).schema
    df.count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
