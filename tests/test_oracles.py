"""Every query with SQL against DuckDB on the smallest tables."""

import datetime as dt
import decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return 0.0 if isinstance(v, float) and v == 0 else v


def _sorted(rows):
    return sorted((tuple(_plain(v) for v in r) for r in rows), key=lambda r: [(v is None, str(type(v)) if isinstance(v, (str, dt.date, bool)) else "", v if v is not None else 0) for v in r])


def test_every_oracle_has_its_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys() and len(entry.oracle_sql()) > 120


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = [[r[names.index(c)] for c in cols] for r in cur.fetchall()]
    assert _sorted(df.select(*[f"`{c}`" for c in cols]).collect()) == _sorted(want)


@pytest.mark.parametrize("name", sorted(entry.queries().keys() - entry.oracle_sql().keys()))
def test_query_without_sql_gives_rows(spark, name):
    assert len(entry.queries()[name](spark, SF).collect()) > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 15
