"""Incremental ingestion and state over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.operators.chunking import windows
from quernstone.sources.sinks import append_new


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "company_ticker string, fiscal_year bigint, section_id string, text string") -> None:
    """Chunk what has arrived as Parquet under ``source`` and append what is new to ``target``.

    Each run handles the files that no earlier run committed and stops.  A
    batch that is run again appends nothing twice, as stored chunks are left out.
    """

    def store(batch: DataFrame, _: int) -> None:
        append_new(windows(batch).dropDuplicates(["chunk_id"]), target)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_state(events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The last value of each key, as a running aggregation."""
    return events.groupBy(key).agg(F.max(at).alias(at), F.max_by(value, at).alias(value))


def deduplicated(events: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Events without repeats of a key within the watermark."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def counts(events: DataFrame, at: str, by: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events by time window; late ones count up to the watermark."""
    return events.withWatermark(at, delay).groupBy(F.window(at, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
