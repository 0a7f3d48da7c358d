from pathlib import Path

import pytest

from inkwell.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="test data is not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql_or_runs(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = queries.QUERIES[name](spark, DATA)
    got = df.collect()
    sql = queries.SQL.get(name)
    if sql is None:
        assert got
        return
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(sql)
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    a = sorted((tuple(fix(r[c]) for c in columns) for r in got), key=repr)
    b = sorted((tuple(fix(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()), key=repr)
    assert a == b
