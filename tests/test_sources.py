"""Files, sinks and streams, and the entry module."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from quernstone.sources import files, sinks
from quernstone.streaming import ingest

REPO = Path(__file__).resolve().parent.parent


def test_filings_by_suffix_year_and_kind(spark, tmp_path):
    deep = tmp_path / "AAPL" / "0000320193-24-000123"
    deep.mkdir(parents=True)
    (deep / "full.txt").write_text("<DOCUMENT><TYPE>10-K\n<TEXT>main\n</TEXT></DOCUMENT>")
    (deep / "a.html").write_text("<a href='x'>Hello</a>")
    (deep / "skip.xml").write_text("no")
    (tmp_path / "0000320193-23-000001.txt").write_bytes(b"old \xff bytes")
    (tmp_path / "loose.txt").write_text("loose")
    found = files.filings(spark, str(tmp_path))
    assert found.count() == 4
    got = {x["path"].rsplit("/", 1)[1]: x["text"] for x in files.texts(files.of_year(found, 2024)).collect()}
    assert got == {"full.txt": "main", "a.html": "Hello", "loose.txt": "loose"}


def test_json_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"companies": ["A", "B"], "default_years": [2024, 2025]}))
    assert files.config(spark, str(tmp_path / "c.json")).count() == 4
    (tmp_path / "u.json").write_text(json.dumps({"0": {"cik_str": 320193, "ticker": "aapl", "title": "Apple Inc."}}))
    assert tuple(files.universe(spark, str(tmp_path / "u.json")).head()) == ("AAPL", "0000320193", "Apple Inc.")
    rows = spark.createDataFrame([("1", ["10-K", "8-K", "10-K", "10-K", "10-K"], list("abcde"))], "cik string, form array<string>, filingDate array<string>")
    assert files.annual_filings(rows).head()["dates"] == ["a", "c", "d"]
    (tmp_path / "t.json").write_text('{"chunk_id": "c", "triplets": [{"source": {"name": "a"}, "relation": "r", "target": {"name": "b"}}, {"relation": "r"}]}\n')
    assert files.triplet_cache(spark, str(tmp_path / "t.json")).count() == 1
    (tmp_path / "k.json").write_text('{"chunk_id": "c", "text": "x"}\nbroken\n')
    assert files.chunk_cache(spark, str(tmp_path / "k.json")).filter("chunk_id IS NOT NULL").count() == 1
    (tmp_path / "s.json").write_text(json.dumps([{"question": "q", "expected_year": 2024}]))
    assert files.samples(spark, str(tmp_path / "s.json")).head()["expected_year"] == 2024


def test_chunks_overwrite_only_their_partitions(spark, tmp_path):
    path = str(tmp_path / "chunks")
    make = lambda *rows: spark.createDataFrame(list(rows), "chunk_id string, company_ticker string, fiscal_year long")
    sinks.save_chunks(make(("a", "A", 1), ("b", "B", 1)), path)
    sinks.save_chunks(make(("c", "A", 1)), path)
    assert {x["chunk_id"] for x in spark.read.parquet(path).collect()} == {"b", "c"}


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    for _ in range(2):
        sinks.append_new(rows, path)
    assert spark.read.parquet(path).count() == 2


def test_stream_ingests_each_file_once(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    row = lambda t: spark.createDataFrame([(t, 2024, "Item 1", "w " * 100)], "company_ticker string, fiscal_year long, section_id string, text string")
    row("A").write.parquet(source)
    ingest.ingest(spark, source, target, state)
    row("B").write.mode("append").parquet(source)
    ingest.ingest(spark, source, target, state)
    ingest.ingest(spark, source, target, state)
    assert sorted(x["company_ticker"] for x in spark.read.parquet(target).collect()) == ["A", "B"]


def test_streaming_aggregations(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 5).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("at"), F.col("id").alias("v"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode, n in (("latest", ingest.latest_state(stream(), "k", "at", "v"), "complete", 5), ("counts", ingest.counts(stream(), "at", "k"), "complete", 10), ("once", ingest.deduplicated(stream(), "k", "at", "3 hours"), "append", 5)):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        assert spark.table(name).count() == n, name
    assert {x["v"] for x in spark.table("latest").collect()} == {95, 96, 97, 98, 99}


def test_entry_without_the_llm_folders(tmp_path):
    for name in ("quernstone", "__spark_entry__.py"):
        (shutil.copytree if (REPO / name).is_dir() else shutil.copy)(REPO / name, tmp_path / name)
    shutil.rmtree(tmp_path / "quernstone" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert 'bm25_topk' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
