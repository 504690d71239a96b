import duckdb
import pytest

from sparkforge.llm.queries import oracle_sql, queries
from sparkforge.session import TABLES


def test_one_query_for_each_operator():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries())
    assert numbers == list(range(1, 11)) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, want = queries()[name](spark, sf), c.sql(oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    rows = sorted(repr(tuple(r[k] for k in order)) for r in df.collect())
    assert rows == sorted(repr(tuple(r[want.columns.index(k)] for k in order)) for r in want.fetchall())
