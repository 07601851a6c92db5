"""Every query of the subpackage that has SQL, against it, on the smallest tables."""

import os

import pytest

from quernstone.llm import queries

from ..test_queries import FOLDER, TABLES, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    want = duck.sql(queries.SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_recursive_ranks_equal_propagation(spark, duck):
    """The tables have no link between hosts; these pages have chains and a circle of them."""
    link = lambda *hosts: " ".join(f'<a href="http://{h}/x">' for h in hosts)
    pages = [(0, "http://a.com/", link("b.org", "c.org")), (1, "http://b.org/", link("c.org", "d.org")), (2, "http://c.org/", link("b.org")), (3, "http://d.org/", link("x.net")), (4, "http://x.net/es/1", ""), (5, "http://e.org/", link("d.org", "a.com")), (6, None, None)]
    from quernstone.llm import urls

    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    con = duck.cursor()
    con.sql("create or replace temp table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", pages)
    want = con.sql(queries.SQL["op8_urls"])
    for row in (dict(zip(want.columns, r)) for r in want.fetchall()):
        mine = got[row["page_id"]]
        assert mine["verdict"] == row["verdict"]
        assert mine["trust"] == pytest.approx(row["trust"], abs=2e-9) and mine["distrust"] == pytest.approx(row["distrust"], abs=2e-9)
