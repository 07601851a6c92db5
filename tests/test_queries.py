"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import pytest

from quernstone.plans import registry

FOLDER = os.environ.get("QUERNSTONE_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.6g}") if abs(value) > 1e6 else round(value, 5)
    return value


def rows(columns, data):
    names = sorted(columns)
    at = [columns.index(c) for c in names]
    return names, sorted((tuple(normal(r[i]) for i in at) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    got = rows(df.columns, df.collect())
    if name in registry.SQL:
        want = duck.sql(registry.SQL[name])
        assert got == rows(want.columns, want.fetchall())
    else:
        assert got[1]
