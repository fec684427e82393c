"""Driver contract: every registered query runs on sf0.001 and matches its
DuckDB oracle (row count, column names, values; order-insensitive)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from ledgerlens.plans import catalog
from tests.conftest import SF_SMALL


def _key(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("orders", "customer", "part"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_keys_match():  # the further operators have tests of their own
    assert set(catalog.QUERIES) <= set(E.queries()) & set(E.oracle_sql())


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["category", "transactions"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(srows) == len(drows)
    assert _key(srows, df.columns) == _key(drows, rel.columns)
