"""File sources: filings, caches, configuration, company lists, feeds."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quernstone.operators.chunking import html_text, main_document

TRIPLETS = "chunk_id string, triplets array<struct<source:map<string,string>,relation:string,target:map<string,string>>>"
CHUNKS = "chunk_id string, text string, company_ticker string, fiscal_year bigint, section_id string, page_number bigint, token_count bigint, metadata map<string,string>"


def accession_year(path: Column) -> Column:
    """The year in an accession number's middle field; null where there is none."""
    yy = F.regexp_extract(path, r"\d{10}-(\d{2})-\d{6}", 1)
    return F.when(yy != "", 2000 + yy.try_cast("bigint"))


def of_year(files: DataFrame, year: int) -> DataFrame:
    """Files of a filing year; those whose path tells none stay."""
    return files.filter(F.coalesce(accession_year(F.col("path")) == year, F.lit(True)))


def filings(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("txt", "html", "htm", "pdf")) -> DataFrame:
    """``path, length, content`` of all files with one of the suffixes, at any depth."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}").load(folder)
    return found.select("path", "length", "content")


def pdf_text(data: bytes) -> str:
    """Text of a PDF's pages; an error without a reader, as a filing without text would vanish unseen."""
    try:
        from pypdf import PdfReader
    except ImportError as missing:
        raise RuntimeError("PDF filings need the package pypdf on the workers") from missing
    return "\n".join(x for x in (p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages) if x.strip())


def texts(files: DataFrame) -> DataFrame:
    """``path, text``: the main document of text files, the visible text of HTML, the pages of PDF; bad bytes are replaced."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, data in zip(frame["path"], frame["content"]):
                if path.lower().endswith(".pdf"):
                    out.append((path, pdf_text(data)))
                else:
                    text = bytes(data).decode("utf-8", "replace")
                    out.append((path, html_text(text) if path.lower().endswith((".html", ".htm")) else text))
            yield pd.DataFrame(out, columns=["path", "text"])

    read = files.select("path", "content").mapInPandas(run, "path string, text string")
    return read.withColumn("text", F.when(F.lower("path").endswith(".txt"), main_document(F.col("text"))).otherwise(F.col("text")))


def config(spark: SparkSession, path: str) -> DataFrame:
    """``company_ticker, fiscal_year``: every configured company in every default year."""
    raw = spark.read.schema("companies array<string>, default_years array<bigint>").option("multiLine", "true").json(path)
    return raw.select(F.explode("companies").alias("company_ticker"), "default_years").select("company_ticker", F.explode("default_years").alias("fiscal_year"))


def universe(spark: SparkSession, path: str) -> DataFrame:
    """``company_ticker, cik, name`` of a JSON object of numbered ``{cik_str, ticker, title}``; the cik has ten digits."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", "map<string,struct<cik_str:string,ticker:string,title:string>>").alias("m"))
    rows = raw.select(F.explode(F.map_values("m")).alias("r"))
    return rows.select(F.upper("r.ticker").alias("company_ticker"), F.lpad("r.cik_str", 10, "0").alias("cik"), F.col("r.title").alias("name"))


def annual_filings(submissions: DataFrame, shown: int = 3) -> DataFrame:
    """``cik, dates``: the first filing dates of form 10-K in parallel arrays ``form`` and ``filingDate``."""
    both = F.arrays_zip("form", "filingDate")
    return submissions.select("cik", F.transform(F.slice(F.filter(both, lambda x: x["form"] == "10-K"), 1, shown), lambda x: x["filingDate"]).alias("dates"))


def chunk_cache(spark: SparkSession, path: str) -> DataFrame:
    """Stored chunks; broken lines give no rows."""
    return spark.read.schema(CHUNKS).option("mode", "DROPMALFORMED").json(path)


def triplet_cache(spark: SparkSession, path: str) -> DataFrame:
    """``chunk_id, source, relation, target``: stored triplets, without invalid ones."""
    rows = spark.read.schema(TRIPLETS).json(path).select("chunk_id", F.explode("triplets").alias("t"))
    return rows.select("chunk_id", F.col("t.source").alias("source"), F.col("t.relation").alias("relation"), F.col("t.target").alias("target")).filter("relation IS NOT NULL AND source['name'] IS NOT NULL AND target['name'] IS NOT NULL")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation samples from a JSON list."""
    return spark.read.schema("question string, ground_truth string, expected_ticker string, expected_year bigint, expected_section string").option("multiLine", "true").json(path)


def feed(spark: SparkSession, path: str) -> DataFrame:
    """News items from JSON lines."""
    return spark.read.schema("item_id bigint, headline string, summary string, related string, source string, url string, at bigint").json(path)
