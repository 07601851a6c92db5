"""Incremental state: append what is new, purge, find gaps, keep what is fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _seconds(at: Column) -> Column:
    return at.cast("timestamp").cast("long")


def new_rows(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of ``batch`` whose key is not stored; repeats within the batch stay."""
    return batch.join(stored.select(key).distinct(), key, "left_anti")


def pending(chunks: DataFrame, cache: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``chunks`` with ``state``: ``cached`` where the cache has the key, else ``pending``."""
    known = cache.select(F.col(key).alias("_k")).distinct()
    return chunks.join(known, chunks[key] == F.col("_k"), "left").withColumn("state", F.when(F.col("_k").isNull(), "pending").otherwise("cached")).drop("_k")


def purge(rows: DataFrame, ticker: str, year: int) -> DataFrame:
    """Rows without those of one company and year; rows with a null in either stay."""
    return rows.filter(~F.coalesce((F.col("company_ticker") == ticker) & (F.col("fiscal_year") == year), F.lit(False)))


def purge_edges(edges: DataFrame, chunks: DataFrame, ticker: str, year: int) -> DataFrame:
    """Edges without those from chunks of one company and year, nor those to its metrics."""
    gone = chunks.filter((F.col("company_ticker") == ticker) & (F.col("fiscal_year") == year)).select(F.col("chunk_id").alias("src"))
    return edges.join(gone, "src", "left_anti").filter(~F.col("dst").startswith(f"{ticker}_{year}_"))


def missing_pairs(companies: DataFrame, years: DataFrame, done: DataFrame) -> DataFrame:
    """``company_ticker, fiscal_year, state``: configured pairs without work done, and done pairs not configured (orphans)."""
    wanted = companies.select("company_ticker").distinct().crossJoin(F.broadcast(years.select("fiscal_year").distinct()))
    have = done.select("company_ticker", "fiscal_year").distinct()
    on = ["company_ticker", "fiscal_year"]
    return wanted.join(have, on, "left_anti").withColumn("state", F.lit("missing")).unionByName(have.join(wanted, on, "left_anti").withColumn("state", F.lit("orphan")))


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, *(F.col("_r")[c].alias(c) for c in rest))


def fresh(rows: DataFrame, at: Column, now: Column, seconds: int) -> DataFrame:
    """Rows younger than a time to live."""
    return rows.filter(_seconds(now) - _seconds(at) < seconds)


def stale_locks(locks: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    return locks.filter(_seconds(now) - _seconds(F.col("at")) >= hours * 3600)


def add_to_config(config: DataFrame, more: DataFrame) -> DataFrame:
    """The sorted union of configured tickers."""
    return config.select(F.upper("company_ticker").alias("company_ticker")).union(more.select(F.upper("company_ticker"))).distinct().orderBy("company_ticker")


def merge_suggestions(lists: dict[str, DataFrame], indexed: DataFrame, universe: DataFrame, k: int = 5) -> DataFrame:
    """Candidates of several lists in their order, the first of each ticker, known and not indexed yet."""
    parts = [df.select("company_ticker", F.lit(name).alias("origin"), F.lit(i).alias("place"), "pos") for i, (name, df) in enumerate(lists.items())]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.join(indexed.select("company_ticker").distinct(), "company_ticker", "left_anti").join(universe.select("company_ticker").distinct(), "company_ticker", "left_semi")
    first = rows.groupBy("company_ticker").agg(F.min(F.struct("place", "pos", "origin")).alias("at"))
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy("at.place", "at.pos", "company_ticker")).cast("bigint"))
    return ranked.filter(F.col("rank") <= k).select("company_ticker", F.col("at.origin").alias("origin"), "rank")


def fuzzy(names: DataFrame, query: str, least: float = 0.5, k: int = 5) -> DataFrame:
    """Names like ``query`` by ``1 - distance / longer length``, case ignored."""
    low = F.lower("name")
    score = 1 - F.levenshtein(low, F.lit(query.lower())) / F.greatest(F.length("name"), F.lit(len(query)))
    return names.select("name", F.round(score, 6).alias("score")).filter(F.col("score") >= least).orderBy(F.desc("score"), F.asc("name")).limit(k)


def cached_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifest rows ``(company_ticker, fiscal_year, path)`` whose file still exists."""
    return manifest.join(listing.select("path").distinct(), "path", "left_semi")
