"""Every query with SQL against DuckDB on the same tables, as multisets of rows."""

import duckdb
import pytest

from tessera.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, sf, duck, name):
    got = catalogue.queries()[name](spark, sf)
    cols = sorted(got.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in got.select(cols).collect())
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0
