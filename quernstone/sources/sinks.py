"""Writers.  All go through Spark's committers, so a lost task leaves nothing half-written."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quernstone.operators.incremental import new_rows


def save_chunks(rows: DataFrame, path: str) -> None:
    """Overwrite the partitions (ticker, year) that ``rows`` touch, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("company_ticker", "fiscal_year").parquet(path)


def save_triplets(rows: DataFrame, path: str) -> None:
    """JSON lines, one for each chunk, sorted within each file."""
    grouped = rows.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("source", "relation", "target"))).alias("triplets")) if dict(rows.dtypes)["source"] == "string" else rows.groupBy("chunk_id").agg(F.collect_list(F.struct("source", "relation", "target")).alias("triplets"))
    grouped.sortWithinPartitions("chunk_id").write.mode("overwrite").json(path)


def append_new(rows: DataFrame, path: str, key: str = "chunk_id") -> None:
    """Append the rows whose key is not stored yet, sorted by key for pruning; create the table if there is none."""
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    fresh = new_rows(rows, spark.read.parquet(path), key) if exists else rows
    fresh.sortWithinPartitions(key).write.mode("append").parquet(path)


def save_report(rows: DataFrame, path: str) -> None:
    """The evaluation report as JSON lines."""
    rows.write.mode("overwrite").json(path)
