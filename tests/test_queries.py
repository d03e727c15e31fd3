"""Every query with SQL gives the same rows as the SQL; the others run over whole tables."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

import pytest

from tests.conftest import DATA
from tessel import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    relation = duck.sql(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of(relation.columns, relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, DATA).collect()
    assert rows


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
