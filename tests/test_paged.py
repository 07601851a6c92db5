"""The source of recorded pages: partitions, pushed filters, expiry, fallback, streams."""

import json

import pytest
from pyspark.sql import functions as F

from quernstone.sources import paged


@pytest.fixture
def root(spark, tmp_path):
    paged.register(spark)

    def write(group, page, at, *rows):
        (tmp_path / group).mkdir(exist_ok=True)
        (tmp_path / group / f"{page}.json").write_text(json.dumps({"at": at, "rows": list(rows)}))

    write("AAPL", 0, 1000, {"price": 1}, {"price": 2})
    write("AAPL", 1, 2000, {"price": 3})
    write("MSFT", 0, 500, {"price": 9})
    write("NONE", 0, 2000)
    write.root = str(tmp_path)
    return write


def read(spark, root, **options):
    return spark.read.format("paged").options(path=root.root, **options).load()


def test_all_pages_in_partitions_by_group(spark, root):
    df = read(spark, root)
    assert df.rdd.getNumPartitions() == 3
    assert sorted((r["grp"], r["page"], json.loads(r["body"])["price"], r["stale"]) for r in df.collect()) == [("AAPL", 0, 1, False), ("AAPL", 0, 2, False), ("AAPL", 1, 3, False), ("MSFT", 0, 9, False)]


def test_pages_of_other_groups_are_not_opened(spark, root):
    with open(f"{root.root}/MSFT/0.json", "w") as f:
        f.write("not JSON")
    assert read(spark, root).filter("grp = 'AAPL'").count() == 3
    assert read(spark, root).filter(F.col("grp").isin("AAPL", "NONE") & (F.col("page") > 0)).count() == 1
    assert read(spark, root).filter("grp = 'nobody'").count() == 0
    with pytest.raises(Exception):
        read(spark, root).count()


def test_expired_pages_stand_in_only_where_nothing_is_fresh(spark, root):
    fresh = read(spark, root, ttl=1200, now=2500)
    assert sorted((r["grp"], r["page"], r["stale"]) for r in fresh.collect()) == [("AAPL", 1, False), ("MSFT", 0, True)]
    assert {r["grp"] for r in read(spark, root, ttl=1200, now=2500, stale="false").collect()} == {"AAPL"}


def test_a_stream_gives_each_page_once(spark, root, tmp_path_factory):
    at = tmp_path_factory.mktemp("stream")

    def run():
        stream = spark.readStream.format("paged").option("path", root.root).load()
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(once=True).start().awaitTermination()
        return spark.read.schema(paged.SCHEMA).parquet(f"{at}/out").count()

    assert run() == 4
    root("MSFT", 1, 3000, {"price": 10}, {"price": 11})
    assert run() == 6
