"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from framelake import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "embeddings", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def _rows(columns, rows):
    return sorted((tuple(_value(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(names)
    assert sorted(got.columns) == columns
    assert _rows(columns, (r.asDict() for r in got.collect())) == _rows(columns, want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows_only(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
