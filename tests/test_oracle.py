"""Every core query with SQL gives the same rows as DuckDB; every one without runs."""

from __future__ import annotations

import pytest

import postlode.queries as core
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, sf_dir, name):
    ok, said = compare(spark, name, core.QUERIES[name], core.SQL.get(name), sf_dir)
    assert ok, said


def test_entry_has_all_queries(spark):
    import __spark_entry__ as e

    assert set(core.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
