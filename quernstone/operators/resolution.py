"""From free text to a company: by ticker, by a ticker among the words, else by likeness.

Likeness is twice the letters of the matching blocks, found longest first and
then to either side, over all letters.  No two texts are more alike than their
letters in common, whatever the order, allow; that bound is computed for a block
of texts and a batch of names at once, and the blocks are matched for the names
that may still be among the best, the best bound first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quernstone.functions.scalars import ticker_key
from quernstone.functions.tables import RESOLUTION_FILLERS
from quernstone.operators.incremental import latest
from quernstone.workspace import in_arrow, materialize

#: Texts that are held against all names at once, and cells that letters are counted in.
TEXTS, CELLS = 500, 64


def cleaned(text: Column) -> Column:
    """Lower case, with blanks for all but letters, digits and ``.&-``, and one blank for several."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s.&-]", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def letters(texts: list[str]) -> np.ndarray:
    """How many letters of each text fall into each cell."""
    out = np.zeros((len(texts), CELLS), np.int32)
    for i, text in enumerate(texts):
        np.add.at(out[i], np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % CELLS, 1)
    return out


def likeness(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _closest(block: list[tuple], k: int, least: float):
    """For each text of the block a task's ``k`` names most like it, by likeness, then by name, the largest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [text for _, text in block]
        mine, size = letters(texts), np.array([len(x) for x in texts])
        best: list[list[tuple]] = [[] for _ in block]
        for batch in batches:
            names, tickers = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            theirs, length = letters(names), np.array([len(x) for x in names])
            for i, text in enumerate(texts):
                bound = 2 * np.minimum(theirs, mine[i]).sum(1) / np.maximum(length + size[i], 1)
                for j in np.argsort(-bound, kind="stable"):
                    if bound[j] < least or (len(best[i]) == k and bound[j] < best[i][0][0]):
                        break
                    score = likeness(names[j], text)
                    if score >= least:
                        entry = (score, names[j], tickers[j])
                        (heapq.heappush if len(best[i]) < k else heapq.heappushpop)(best[i], entry)
        rows = [(block[i][0], *entry) for i, found in enumerate(best) for entry in found]
        columns = list(zip(*rows)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.float64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "score", "low", "ticker"])

    return run


def closest(texts: DataFrame, universe: DataFrame, k: int = 5, least: float = 0.5) -> DataFrame:
    """``query_id, ticker, score, rank``: the names most like each text, at least ``least``.

    ``texts(query_id, text)`` are clean, a text's names are the ticker and name of
    ``universe(ticker, name)`` in lower case; ties go to the largest name.  The score
    is that of the text against the name, rounded; the rank that of the name
    against the text, which may differ where blocks tie.  Texts are taken in bounded
    blocks; the universe is not shuffled.
    """
    names = universe.select("ticker", F.lower(F.concat_ws(" ", "ticker", "name")).alias("low"))
    asked = materialize(texts.select(F.col("query_id").cast("long").alias("query_id"), "text").filter("text <> ''"), "asked")
    n = max(-(-asked.count() // TEXTS), 1)
    out = None
    for part in range(n):
        block = [tuple(r) for r in asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == part).collect()]
        found = in_arrow(names, _closest(block, k, least), "query_id long, score double, low string, ticker string")
        out = found if out is None else out.union(found)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("low")))
    out = out.withColumn("rank", place.cast("long")).filter(F.col("rank") <= k)
    reverse = F.udf(lambda a, b: round(likeness(a, b), 3), "double")  # a few rows for each text
    return out.join(asked, "query_id").select("query_id", "ticker", reverse("text", "low").alias("score"), "rank")


def resolve(texts: DataFrame, universe: DataFrame, memo: DataFrame | None = None, k: int = 5, least: float = 0.5) -> DataFrame:
    """``query_id, exact, rank, ticker, name, score``: the company that each text names, or candidates to ask about.

    ``texts(query_id, text)``, ``universe(ticker, name)``.  A text that ``memo(text,
    ticker)`` knows, one that is a ticker (dots, blanks and case aside), and one
    whose words hold one ticker and at most two words more than numbers of years
    and fillers, is exact and has one row.  The others have the tickers among
    their words, in their order, and then the names most like them; a text with
    neither, such as an empty one, has no row.  Of tickers that are alike but for
    dots the smallest counts.
    """
    asked = materialize(texts.select(F.col("query_id").cast("long").alias("query_id"), cleaned(F.col("text")).alias("text")), "asked")
    keys = universe.groupBy(ticker_key(F.col("ticker")).alias("key")).agg(F.min("ticker").alias("ticker"))
    whole = asked.withColumn("key", ticker_key(F.col("text"))).join(keys, "key").select("query_id", "ticker", F.lit(0).alias("way"))
    known = None if memo is None else asked.join(latest_memo(memo), "text").select("query_id", "ticker", F.lit(-1).alias("way"))
    words = asked.select("query_id", "text", F.posexplode(F.regexp_extract_all("text", F.lit("([a-z0-9.]{1,10})"), F.lit(1))).alias("place", "word"))
    met = materialize(words.withColumn("key", ticker_key(F.col("word"))).join(keys, "key").groupBy("query_id", "text", "ticker").agg(F.min("place").alias("place")), "met")
    alone = met.groupBy("query_id", "text").agg(F.min("ticker").alias("ticker"), F.count("*").alias("n")).filter("n = 1")
    low = F.lower("ticker")
    spelled = lambda t: F.concat(F.lit(r"(?U)\b"), F.regexp_replace(t, r"([^\w\s])", r"\\$1"), F.lit(r"\b"))
    rest = F.regexp_replace(F.regexp_replace("text", spelled(low), F.lit(" ")), spelled(F.regexp_replace(low, r"\.", "")), F.lit(" "))
    rest = F.regexp_replace(F.regexp_replace(rest, r"(?U)\b20(?:2[0-9]|19)\b", " "), rf"(?U)\b({'|'.join(RESOLUTION_FILLERS)})\b", " ")
    alone = alone.filter(F.size(F.regexp_extract_all(rest, F.lit(r"(?U)(\S+)"), F.lit(1))) <= 2).select("query_id", "ticker", F.lit(1).alias("way"))
    exact = whole.union(alone) if known is None else known.union(whole).union(alone)
    exact = materialize(exact.groupBy("query_id").agg(F.min_by("ticker", F.struct("way", "ticker")).alias("ticker")), "exact")
    named = universe.groupBy("ticker").agg(F.min("name").alias("name"))
    open_ = asked.join(exact, "query_id", "left_anti")
    literal = met.join(open_.select("query_id"), "query_id", "left_semi").select("query_id", "ticker", F.lit(1.0).alias("score"), F.lit(0).alias("list"), F.col("place").cast("long").alias("at"))
    like = closest(open_, universe, k, least).select("query_id", "ticker", "score", F.lit(1).alias("list"), F.col("rank").alias("at"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("list", "at")).cast("long").alias("rank")
    candidates = literal.union(like).select("query_id", F.lit(False).alias("exact"), rank, "ticker", "score")
    sure = exact.select("query_id", F.lit(True).alias("exact"), F.lit(1).cast("long").alias("rank"), "ticker", F.lit(1.0).alias("score"))
    return sure.union(candidates).join(named, "ticker").select("query_id", "exact", "rank", "ticker", "name", "score")


def latest_memo(memo: DataFrame) -> DataFrame:
    """``text, ticker``: the last resolution of each clean text."""
    return latest(memo.select(cleaned(F.col("text")).alias("text"), F.upper("ticker").alias("ticker"), "at"), "text", ["at", "ticker"]).select("text", "ticker")


def record(resolutions: DataFrame, path: str) -> None:
    """Append confirmed resolutions ``(text, ticker)`` to the memo under ``path``; the last one of a text counts."""
    resolutions.select("text", "ticker", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """The memo under ``path``; empty if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = "text string, ticker string, at timestamp"
    exists = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)
