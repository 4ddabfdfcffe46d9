"""Every registered query: rows and types against its SQL on a second engine, or rows alone."""

from __future__ import annotations

import pytest
from conftest import SF
from oracle import connect, differences

from skyquad import queries as engine

QUERIES, ORACLES = engine.queries(), engine.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_agrees_with_its_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_registers_all():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
