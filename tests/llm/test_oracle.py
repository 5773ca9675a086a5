"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from tracewarden.llm.queries import ORACLE_SQL, QUERIES

TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    cur = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == names
    want = sorted(tuple(str(r[columns.index(c)]) for c in names) for r in cur.fetchall())
    assert sorted(tuple(str(v) for v in r) for r in df.select(names).collect()) == want
