"""Every registered raster query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from rasterjobs.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, str):
        return v
    v = float(v)
    return None if math.isnan(v) else v + 0.0


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    found = [tuple(plain(r[i]) for i in order) for r in table]
    return sorted(found, key=lambda r: tuple((v is None, str(v) if isinstance(v, str) else "", v if isinstance(v, float) else 0.0) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    expected = rows(want.columns, want.fetchall())
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a == pytest.approx(b, abs=2e-6) if not any(isinstance(x, str) or x is None for x in a) else a == b
