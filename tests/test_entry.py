from pathlib import Path

import pytest

import __spark_entry__ as e

DATA = "/root/testdata/sf0.001"


def test_sql_only_for_registered_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not Path(DATA).exists(), reason="test data is not here")
@pytest.mark.parametrize("name", sorted(n for n in e.queries() if not n.startswith("p") or n.startswith(("p2_", "postings", "positional", "page_table", "posting_"))))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = e.queries()[name](spark, DATA)
    got = df.collect()
    sql = e.oracle_sql().get(name)
    if sql is None:
        assert got is not None
        return
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    columns = sorted(df.columns)
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    a = sorted((tuple(fix(r[c]) for c in columns) for r in got), key=repr)
    b = sorted((tuple(fix(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()), key=repr)
    assert a == b
