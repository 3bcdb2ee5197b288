"""Every registered query equals its DuckDB oracle on the smallest test tables."""

import decimal

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from marketlens.plans.oracle import oracle_queries
from marketlens.plans.registry import ALL_QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES = ALL_QUERIES
ORACLE = oracle_queries()


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 6) if isinstance(v, float) else v


def _key(r):
    return tuple((x is None, str(x)) for x in r)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)
    rel = con.execute(ORACLE[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(dcols) == cols
    # same column types on both sides
    from marketlens.plans.oracle import DUCK_TYPES

    spark_types = {f.name: DUCK_TYPES[f.dataType.simpleString()] for f in df.schema.fields}
    duck_types = {d[0]: str(d[1]).upper() for d in rel.description}
    assert spark_types == duck_types
    idx = [dcols.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=_key)
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "payment_growth_pct" in df.columns
