"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

from __future__ import annotations

import pytest
from conftest import SF001
from oracle import compare, duck_connection

from pitloom.plans.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF001)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    r = compare(spark, name, SF001, con)
    assert r["schema_match"], (list(r["spark"].columns), list(r["oracle"].columns))
    assert r["rows_match"], r["rows"]
    assert r["hash_match"]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF001).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_contract(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
