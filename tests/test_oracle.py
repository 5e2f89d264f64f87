"""Every registered query against its DuckDB statement."""

from __future__ import annotations

import pytest
from panel_rows import SMALL

import __spark_entry__ as entry_module
from check import difference, oracle_connection
from ledgerloom.plans import catalog

STATEMENTS = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SMALL)


def test_every_query_has_a_statement():
    assert set(catalog.queries()) <= set(STATEMENTS) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_equals_oracle(spark, oracle, name):
    ours = entry_module.queries()[name](spark, SMALL).toArrow()
    assert difference(ours, oracle.sql(STATEMENTS[name]).to_arrow_table()) is None


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
