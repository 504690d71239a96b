"""Every registered query of the engine against DuckDB on the same tables."""

import duckdb
import pytest

from sparkforge import suite
from sparkforge.session import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def values(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(suite.queries()))
def test_query(spark, sf, duck, name):
    df = suite.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name not in suite.oracle_sql():
        assert rows
        return
    want = duck.sql(suite.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert values(rows, df.columns) == values(want.fetchall(), want.columns)
