"""Every registered query equals its DuckDB oracle on the smallest test data."""

import datetime as dt
import decimal

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF001

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _canon(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_norm(r[i]) for i in order)) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["package_name", "total_requests", "total_requests_fmt"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    got = _canon(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(E.oracle_sql()[name])
    want = _canon(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == want


def test_every_query_has_an_oracle():
    optional = set(E.llm.queries() if E.llm else ())
    assert set(E.oracle_sql()) <= set(E.queries()) and set(E.queries()) - optional <= set(E.oracle_sql())


_DUCK_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "date": "DATE", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - {"stream_ingest"}))
def test_column_types_match_oracle(spark, duck, name):
    spark_types = {c: _DUCK_TYPES.get(t, t) for c, t in E.queries()[name](spark, SF001).dtypes}
    rel = duck.sql(E.oracle_sql()[name])
    assert spark_types == dict(zip(rel.columns, [str(t) for t in rel.types]))
