"""Tables of a data folder, and their roles in the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.functions.tables import SECTION_ITEMS
from quernstone.workspace import BROADCAST_ROWS, shuffled


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as chunks: ticker is the source, years alternate, sections go round."""
    items = F.array(*map(F.lit, SECTION_ITEMS))
    docs = table(spark, folder, "documents")
    return docs.select(
        F.col("doc_id").alias("chunk_id"),
        "text",
        F.col("source").alias("company_ticker"),
        (2024 + F.col("doc_id") % 2).cast("bigint").alias("fiscal_year"),
        F.element_at(items, (F.col("doc_id") % len(SECTION_ITEMS) + 1).cast("int")).alias("section_id"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as chunk vectors."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("bigint").alias("label"))


def _suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("src"), "s_nationkey")


def line_edges(spark: SparkSession, folder: str, of: DataFrame | None = None) -> DataFrame:
    """The edges of ``graph_edges`` that order lines give: segments and metrics."""
    part, name = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("dst")), _suppliers(spark, folder)
    line = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey", F.year("l_shipdate").alias("year"))
    if of is not None:
        name = name.join(of.filter("src_label = 'Company'").select("src"), "src", "left_semi")
        line = line.join(name.select("l_suppkey"), "l_suppkey", "left_semi")
    else:
        part, name = (shuffled(t, t.count() > BROADCAST_ROWS) for t in (part, name))
    served = line.select("l_suppkey", "l_partkey").distinct().join(part, "l_partkey")
    segments = served.select("l_suppkey", "dst").distinct().join(name, "l_suppkey").select(F.lit("OPERATES_IN").alias("rel"), F.lit("Company").alias("src_label"), "src", F.lit("BusinessSegment").alias("dst_label"), "dst")
    metrics = line.select("l_suppkey", "year").distinct().join(name, "l_suppkey").select(F.lit("REPORTED_METRIC").alias("rel"), F.lit("Company").alias("src_label"), "src", F.lit("FinancialMetric").alias("dst_label"), F.concat_ws("_", F.upper("src"), F.col("year").cast("string"), F.lit("revenue")).alias("dst"))
    return segments.unionByName(metrics)


def rival_groups(spark: SparkSession, folder: str) -> DataFrame:
    """``name, nation, n``: how many suppliers of a nation have a name; all of a nation with different names compete, so pairs need not be written out."""
    return table(spark, folder, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).dropna().groupBy("name", "nation").agg(F.count("*").alias("n"))


def graph_edges(spark: SparkSession, folder: str, of: DataFrame | None = None) -> DataFrame:
    """Companies are suppliers; segments the brands they deliver; metrics their yearly revenue; competitors all others of their nation.

    With ``of(src_label, src)`` the edges of these nodes alone: only their lines
    are read and only their competitors are paired.
    """
    name = every = _suppliers(spark, folder)
    if of is not None:
        name = every.join(of.filter("src_label = 'Company'").select("src"), "src", "left_semi")
    pairs = name.join(every.select(F.col("src").alias("dst"), "s_nationkey"), "s_nationkey").filter("src <> dst")
    rivals = pairs.select(F.lit("COMPETES_WITH").alias("rel"), F.lit("Company").alias("src_label"), "src", F.lit("Company").alias("dst_label"), "dst")
    return line_edges(spark, folder, of).unionByName(rivals)


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly revenue of each supplier, under a composite id."""
    line = table(spark, folder, "lineitem").select("l_suppkey", F.year("l_shipdate").cast("bigint").alias("fiscal_year"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    sums = line.groupBy("l_suppkey", "fiscal_year").agg(F.sum("revenue").alias("amount"))
    named = sums.join(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("ticker")), "l_suppkey")
    return named.select(F.concat_ws("_", F.upper("ticker"), F.col("fiscal_year").cast("string"), F.lit("revenue")).alias("metric_id"), "ticker", "fiscal_year", F.lit("revenue").alias("name"), F.round("amount", 2).alias("amount"), F.lit("USD").alias("unit"))
