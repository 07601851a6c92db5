"""Conversations: history, trimming, intents, follow-ups, open calls, news, and the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quernstone.functions import tables as t
from quernstone.functions.scalars import any_of

TEXT_CHARS, TITLE_CHARS, KEPT, SHOWN, SHOWN_CHARS = 4000, 60, 100, 8, 500


def summaries(messages: DataFrame) -> DataFrame:
    """``conv_id, title, turns, n_messages`` of ``messages(conv_id, turn, role, text)``.

    The title is the start of the first question; a turn is two messages.
    """
    title = F.min_by(F.substring("text", 1, TITLE_CHARS), F.when(F.col("role") == "user", F.col("turn")))
    out = messages.groupBy("conv_id").agg(title.alias("title"), F.count("*").alias("n_messages"))
    return out.select("conv_id", "title", F.floor(F.col("n_messages") / 2).alias("turns"), "n_messages")


def listing(messages: DataFrame) -> DataFrame:
    """``summaries`` with ``updated_at``, the newest conversations first, from ``messages`` with a column ``at``."""
    newest = messages.groupBy("conv_id").agg(F.max("at").alias("updated_at"))
    return summaries(messages).join(newest, "conv_id").orderBy(F.desc_nulls_last("updated_at"), "conv_id")


def trim(messages: DataFrame, kept: int = KEPT, chars: int = TEXT_CHARS) -> DataFrame:
    """The last ``kept`` messages of each conversation, each cut to ``chars`` characters."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("_back", back).filter(F.col("_back") <= kept).select("conv_id", "turn", "role", F.substring("text", 1, chars).alias("text"))


def history(messages: DataFrame, shown: int = SHOWN, chars: int = SHOWN_CHARS) -> DataFrame:
    """``conv_id, history``: the last messages as lines of ``Prev Q`` and ``Prev A``."""
    line = F.concat(F.when(F.col("role") == "user", "Prev Q: ").otherwise("Prev A: "), F.col("text"))
    rows = trim(messages.filter(F.col("role").isin("user", "assistant")), shown, chars).select("conv_id", F.struct("turn", line.alias("line")).alias("x"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("history"))


def without(messages: DataFrame, conv_ids: list[int]) -> DataFrame:
    """Messages without some conversations."""
    return messages.filter(~F.col("conv_id").isin(*conv_ids))


def intent(text: Column, ticker: Column, year: Column) -> Column:
    """``ingest`` where a verb asks for it, nothing takes it back, and ticker and year are named; else ``retrieve``."""
    low = F.lower(F.trim(text))
    asks = any_of([low.contains(v) for v in t.INGEST_VERBS]) & ~any_of([low.contains(n) for n in t.INGEST_NEGATIONS])
    return F.when(asks & ticker.isNotNull() & year.isNotNull(), "ingest").otherwise("retrieve")


def follow_up(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, turn, ticker, year)`` with what was named last filled in: the ticker, and with it the year."""
    run = Window.partitionBy("conv_id").orderBy("turn")
    last = F.last(F.when(F.col("ticker").isNotNull(), F.struct("ticker", "year")), ignorenulls=True).over(run)
    return messages.withColumn("_last", last).select("conv_id", "turn", F.coalesce("ticker", "_last.ticker").alias("ticker"), F.coalesce("year", "_last.year").alias("year"))


def open_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls without a result, as synthetic results."""
    return calls.join(results.select("call_id").distinct(), "call_id", "left_anti").withColumn("content", F.lit("(interrupted)"))


def news(items: DataFrame, symbol: str, keywords: list[str], k: int = 6) -> DataFrame:
    """The ``k`` most relevant items, then latest: 3 where ``related`` names the symbol, 1 where the text holds a keyword."""
    related = F.transform(F.split(F.coalesce("related", F.lit("")), ","), lambda x: F.upper(F.trim(x)))
    named = F.array_contains(related, symbol) | F.array_contains(F.transform(related, lambda x: F.replace(x, F.lit("."), F.lit(""))), symbol.replace(".", ""))
    text = F.upper(F.concat_ws(" ", F.coalesce("headline", F.lit("")), F.coalesce("summary", F.lit(""))))
    score = F.when(named, 3).when(any_of([text.contains(w.upper()) for w in keywords if len(w) > 1]), 1).otherwise(0)
    rows = items.withColumn("relevance", score.cast("bigint")).filter("relevance > 0")
    return rows.orderBy(F.desc("relevance"), F.desc("at"), F.asc("item_id")).limit(k)


def checks(results: DataFrame, names: list[str]) -> DataFrame:
    """Rows with ``score``, the share of their boolean checks that hold."""
    held = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in names), F.lit(0))
    return results.withColumn("score", held / float(len(names)))


def gate(scored: DataFrame, names: list[str], least: float = 0.85) -> DataFrame:
    """One row: samples, mean score, how many pass each check, and whether the mean reaches the gate."""
    counts = [F.sum(F.coalesce(F.col(c), F.lit(False)).cast("int")).cast("bigint").alias(c) for c in names]
    out = scored.agg(F.count("*").alias("samples"), F.round(F.avg("score"), 6).alias("mean_score"), *counts)
    return out.withColumn("passed", F.col("mean_score") >= least)


def append_turns(messages: DataFrame, more: DataFrame) -> DataFrame:
    """Messages with new questions and answers after the last turn of their conversation, cut and trimmed.

    ``more(conv_id, seq, question, answer)``; each row gives two messages.
    """
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("last"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq")) - 1
    said = more.withColumn("place", place).join(last, "conv_id", "left").withColumn("base", F.coalesce("last", F.lit(-1)) + 1 + 2 * F.col("place"))
    both = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("text"), F.col("base").alias("turn")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text"), (F.col("base") + 1).alias("turn")))
    new = said.select("conv_id", F.explode(both).alias("m")).select("conv_id", F.col("m.turn").cast("bigint").alias("turn"), "m.role", "m.text")
    return trim(messages.select("conv_id", "turn", "role", "text").unionByName(new))


def sample_checks(samples: DataFrame, results: DataFrame, cited: DataFrame) -> DataFrame:
    """The boolean checks of each evaluation sample.

    ``samples(query_id, expected_ticker, expected_year, expected_section)``,
    ``results(query_id, answer, dense, sparse, graph)`` with the sizes of the
    lists, ``cited(query_id, company_ticker, fiscal_year, section_id)``.
    """
    sets = cited.groupBy("query_id").agg(F.collect_set(F.lower("company_ticker")).alias("tickers"), F.collect_set(F.col("fiscal_year").cast("string")).alias("years"), F.collect_set(F.lower("section_id")).alias("sections"), F.count("*").alias("n"))
    rows = samples.join(results, "query_id", "left").join(sets, "query_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(
        "query_id",
        yes(F.trim("answer") != "").alias("has_answer"),
        yes(F.col("n") > 0).alias("has_citations"),
        yes(F.array_contains("tickers", F.lower("expected_ticker"))).alias("ticker_hit"),
        yes(F.array_contains("years", F.col("expected_year").cast("string"))).alias("year_hit"),
        yes(F.array_contains("sections", F.lower("expected_section"))).alias("section_hit"),
        yes(F.col("dense") > 0).alias("dense_hit"),
        yes(F.col("sparse") > 0).alias("sparse_hit"),
        yes(F.col("graph") > 0).alias("graph_hit"),
    )
