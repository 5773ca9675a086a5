"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from tracewarden.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = norm(df.select([f"`{c}`" for c in names]).collect())
    cur = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    want = norm([[r[k] for k in order] for r in cur.fetchall()])
    assert got == want
    assert got or name in ("rule_bad_regex", "rule_bad_condition", "rule_array_any", "endpoint_filter")
