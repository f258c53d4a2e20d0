"""Every query against its DuckDB statement; those without one must run and give rows."""

import math

import pytest

import __spark_entry__ as entry
from spatiotrack.plans import registry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def text(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 8) + 0.0) if isinstance(v, float) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table(df.columns, rows) == table(want.columns, want.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "zone" in df.columns
