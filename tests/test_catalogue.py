"""Every catalogue query against its SQL in another engine, on the smallest tables."""

import math

import pytest

from skein.plans import catalogue, oracle

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def comparable(row):
    return tuple((x is None, round(x, 9) if isinstance(x, float) and math.isfinite(x) else x) for x in row)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    rel = duck.sql(oracle.SQL[name])
    names = sorted(rel.columns)
    want = sorted(comparable(r[rel.columns.index(c)] for c in names) for r in rel.fetchall())
    df = catalogue.queries()[name](spark, SF)
    assert sorted(df.columns) == names
    got = sorted(comparable(r[c] for c in names) for r in df.collect())
    assert len(got) == len(want) and len(got) > 0
    assert got == want


def test_each_query_has_sql():
    assert set(oracle.SQL) == set(catalogue.queries())
