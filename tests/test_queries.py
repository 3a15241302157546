"""Every query with SQL against DuckDB; the others must run and have rows or be known to have none here."""

import pytest

from parity import ROOT, same
from skein.source_queries import QUERIES, SQL

EMPTY = {"focus_relationships", "minimum_edges", "schema_blobs"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, ROOT).count() > 0 or name in EMPTY


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
