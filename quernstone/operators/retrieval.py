"""Ranked retrieval: BM25, exact kNN, rank fusion, grounding, re-ranking.

Questions are a DataFrame and every operator carries ``query_id``, so a batch
of questions is one plan.  Questions are few and small next to the corpus; they
are sent to the executors by Spark where their size allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quernstone.functions.scalars import bm25_tokens, jaccard, sigmoid, word_set
from quernstone.workspace import new_path, spread

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
#: Words of questions, one row for each question and word, that are sent to all tasks.
ASKED = 10_000
#: Query vectors that are sent to all tasks at once.
VECTORS = 1_000
#: Items that are held against all documents at once, and rows that a task sends at once.
ITEMS, ROWS = 500, 200_000


def top(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark limits each task's groups before the shuffle."""
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    return ranked.filter(F.col(rank) <= k)


class Bm25Index(NamedTuple):
    """``postings(term, chunk_id, tf, dl)`` sorted by term, ``terms(term, df)``, and the corpus's three numbers."""

    postings: DataFrame
    terms: DataFrame
    chunks: int
    mean_length: float
    mean_weight: float


def build_index(chunks: DataFrame, path: str | None = None, only: list[str] | None = None) -> Bm25Index:
    """Write the index of ``chunks(chunk_id, text)`` under ``path``, or for this session into the shared folder.

    Each text is cut into words once.  A posting without a term keeps each
    chunk's length, words or not.  Postings are sorted by term in each file, so
    that a search reads the blocks of its terms alone.  For a single search they
    may be those of ``only`` some terms; all numbers come from the whole corpus.
    """
    spark = chunks.sparkSession
    path = path or new_path(spark, "bm25")
    words = spread(chunks.select("chunk_id", "text")).select("chunk_id", bm25_tokens(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
    kept = F.col("words") if only is None else F.filter("words", lambda w: w.isin(only))
    each = words.select("chunk_id", F.size("words").alias("dl"), F.explode(F.concat(kept, F.array(F.lit(None).cast("string")))).alias("term"))
    postings = each.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))
    postings.sortWithinPartitions("term").write.parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    named = stored.filter("term IS NOT NULL") if only is None else words.select(F.explode(F.array_distinct("words")).alias("term"))
    terms = named.groupBy("term").agg(F.count("*").alias("df"))
    terms.sortWithinPartitions("term").write.parquet(f"{path}/terms")
    row = stored.filter("term IS NULL").agg(F.sum("tf").alias("n"), (F.sum(F.col("tf") * F.col("dl")) / F.sum("tf")).alias("mean_length")).head()
    n = row["n"] or 0
    weight = spark.read.parquet(f"{path}/terms").agg(F.avg(_raw_weight(n)).alias("w")).head()["w"]
    numbers = [(n, float(row["mean_length"] or 0.0), float(weight or 0.0))]
    spark.createDataFrame(numbers, "n long, mean_length double, mean_weight double").coalesce(1).write.parquet(f"{path}/numbers")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> Bm25Index:
    """The index that ``build_index`` wrote under ``path``."""
    row = spark.read.parquet(f"{path}/numbers").head()
    return Bm25Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), *row)


def _raw_weight(n: int) -> Column:
    return F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def search(index: Bm25Index, questions: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the best chunks with a positive score; ties by chunk_id.

    Words that a question repeats count each time.  A term in more than half of
    the chunks would weigh below 0; it gets ``EPSILON`` times the mean weight of
    the vocabulary instead.  Up to ``ASKED`` words of questions go to all tasks
    and to the scan as a filter; more are joined.
    """
    asked = questions.select("query_id", F.explode(bm25_tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    first = asked.limit(ASKED + 1).collect()
    raw = _raw_weight(index.chunks)
    weight = F.when(raw < 0, F.lit(index.mean_weight * EPSILON)).otherwise(raw)
    if len(first) <= ASKED:
        wanted = F.col("term").isin(sorted({r["term"] for r in first}))
        few = asked.sparkSession.createDataFrame(first, asked.schema)
        weights = F.broadcast(index.terms.filter(wanted).join(F.broadcast(few), "term").select("query_id", "term", "qn", weight.alias("idf")))
        postings = index.postings.filter(wanted)
    else:
        weights = index.terms.join(asked, "term").select("query_id", "term", "qn", weight.alias("idf"))
        postings = index.postings.filter("term IS NOT NULL")
    part = F.col("qn") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(index.mean_length)))
    scored = postings.join(weights, "term").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    return top(scored.filter("score > 0"), ["query_id"], [F.desc(F.round("score", 9)), F.asc("chunk_id")], k)


def bm25(chunks: DataFrame, questions: DataFrame, k: int = 20) -> DataFrame:
    """``search`` in an index that is made for it, of the questions' terms if these are few."""
    asked = questions.select(F.explode(bm25_tokens(F.col("question"))).alias("term")).distinct().limit(ASKED + 1).collect()
    return search(build_index(chunks, only=sorted(r["term"] for r in asked) if len(asked) <= ASKED else None), questions, k)


def squared_distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def knn(vectors: DataFrame, queries: DataFrame, k: int = 15, keep: Column | None = None, by: str | None = None) -> DataFrame:
    """``query_id, chunk_id, distance, rank``: exact nearest by squared L2, after the prefilter; ties by chunk_id.

    ``vectors(chunk_id, embedding, ...)``, ``queries(query_id, query_vector)``;
    the queries go to every task in blocks of about ``VECTORS``.  With ``by``, a
    column of ``vectors``, a query whose array ``only`` is not empty takes the rows
    whose value it holds.  A vector that is null, of another length, or with a
    component that is null or not finite is near to nothing.
    """
    rows = (vectors if keep is None else vectors.filter(keep)).select("chunk_id", "embedding", *([by] if by else []))
    n = max(-(-queries.count() // VECTORS), 1)
    out = None
    for block in range(n):
        asked = queries if n == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == block)
        pairs = rows.crossJoin(F.broadcast(asked))
        if by:
            pairs = pairs.filter((F.size("only") <= 0) | F.array_contains("only", F.col(by)))
        scored = pairs.select("query_id", "chunk_id", squared_distance("embedding", "query_vector").alias("distance")).filter(F.col("distance") < float("inf"))
        near = top(scored, ["query_id"], [F.asc("distance"), F.asc("chunk_id")], k)
        out = near if out is None else out.union(near)
    return out


def rrf(hits: DataFrame, k: int = 20, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ``hits(query_id, source, chunk_id, rank)``, ranks from 1.

    One aggregation in place of full outer joins; a chunk that one list repeats
    counts each time.  Ties go to the source that comes first by name and rank.
    """
    fused = hits.groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (F.col("rank") + constant)).alias("rrf_score"),
        F.min(F.struct("source", "rank")).alias("at"),
        F.count("*").alias("n_lists"),
    )
    return top(fused, ["query_id"], [F.desc(F.round("rrf_score", 12)), F.asc("at.source"), F.asc("at.rank"), F.asc("chunk_id")], k).drop("at")


def ground(candidates: DataFrame, tickers: DataFrame) -> DataFrame:
    """Candidates of the tickers that their question names; all of them where it names none.

    ``tickers(query_id, tickers)`` holds an array, empty or absent for none.
    """
    joined = candidates.join(tickers, "query_id", "left")
    named = F.coalesce(F.size("tickers"), F.lit(0)) > 0
    return joined.filter(~named | F.array_contains("tickers", F.col("company_ticker"))).drop("tickers")


def keep_first(candidates: DataFrame) -> DataFrame:
    """The first candidate by rank of each question, ticker and section, whatever the year."""
    return top(candidates, ["query_id", "company_ticker", "section_id"], [F.asc("rank")], 1, "_first").drop("_first")


def lexical_score(question: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder's logit, from the word overlap."""
    return 8 * jaccard(word_set(question), word_set(text)) - 1


def _mmr(k: int, weight: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "rank"], ascending=[False, True], kind="stable").reset_index(drop=True)
        if len(rows) <= k:
            chosen = list(range(len(rows)))
        else:
            sets, chosen, near = [set(x) for x in rows["words"]], [0], [0.0] * len(rows)
            while len(chosen) < k:
                last = sets[chosen[-1]]
                for i, own in enumerate(sets):
                    union = len(own | last)
                    near[i] = max(near[i], len(own & last) / union if own and last else 0.0)
                rest = [i for i in range(len(rows)) if i not in chosen]
                chosen.append(max(rest, key=lambda i: (weight * rows["score"][i] - (1 - weight) * near[i], -i)))
        out = rows.loc[chosen, ["query_id", "chunk_id", "score"]].copy()
        out["position"] = range(1, len(out) + 1)
        return out

    return run


def rerank(candidates: DataFrame, k: int = 5, min_score: float = 0.2, weight: float = 0.7, scorer: Callable[[Column, Column], Column] = lexical_score) -> DataFrame:
    """``query_id, chunk_id, score, position`` by sigmoid score and diversity.

    ``candidates(query_id, question, chunk_id, text, rank)``, at most a fused
    list for each question.  Scores below ``min_score`` go; of what is left the
    best is taken first, then always the one with the highest
    ``weight * score - (1 - weight) * likeness`` to those taken.
    """
    scored = candidates.withColumn("score", sigmoid(scorer(F.col("question"), F.col("text"))))
    if min_score > 0:
        scored = scored.filter(F.col("score") >= min_score)
    scored = scored.select("query_id", "chunk_id", "rank", "score", word_set(F.col("text")).alias("words"))
    schema = f"query_id {scored.schema['query_id'].dataType.simpleString()}, chunk_id {scored.schema['chunk_id'].dataType.simpleString()}, score double, position long"
    return scored.groupBy("query_id").applyInPandas(_mmr(k, weight), schema)


def contexts(ranked: DataFrame) -> DataFrame:
    """``query_id, context``: numbered blocks for a generator, in order, separated by rules."""
    block = F.format_string("[%d] (%s %s, %s)\n%s", "position", "company_ticker", F.col("fiscal_year").cast("string"), "section_id", "text")
    blocks = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", block.alias("block")))).alias("blocks"))
    return blocks.select("query_id", F.array_join(F.col("blocks.block"), "\n---\n").alias("context"))


def citations(ranked: DataFrame, metric_chunks: DataFrame) -> DataFrame:
    """Ranked chunks and the chunks of metric rows that are not among them, with score 1."""
    extra = metric_chunks.dropDuplicates(["query_id", "chunk_id"]).join(ranked, ["query_id", "chunk_id"], "left_anti")
    return ranked.select("query_id", "chunk_id", "score", F.lit("context").alias("source")).unionByName(extra.select("query_id", "chunk_id", F.lit(1.0).alias("score"), F.lit("metrics").alias("source")))


def _similarity(names: list[str], block: list[tuple]):
    """The rows of a block of ``(item_id, words)`` with each document of which it shares a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: k for k, w in enumerate(sorted({w for _, words in block for w in words}))}
        vocabulary, ids = pa.array(list(place), pa.string()), pa.array([i for i, _ in block], pa.int64())
        size, has = np.array([len(words) for _, words in block]), np.zeros((len(place), len(block)), np.int32)
        for k, (_, words) in enumerate(block):
            has[[place[w] for w in words], k] = 1
        for batch in batches:
            lists = batch.column(1)
            lengths = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
            word = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            ends, held, rows = np.concatenate([[0], np.cumsum(lengths)]), [], 0
            for d in range(len(lengths)):
                mine = word[ends[d] : ends[d + 1]]
                common = has[mine[mine >= 0]].sum(0)
                some = np.flatnonzero(common)
                held.append((some, np.full(len(some), d), common[some] / (size[some] + lengths[d] - common[some])))
                rows += len(some)
                if rows >= ROWS or d == len(lengths) - 1:
                    item, doc, score = (np.concatenate(x) for x in zip(*held))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(item)), batch.column(0).take(pa.array(doc)), pa.array(score)], names)
                    held, rows = [], 0

    return run


def set_similarity(items: DataFrame, docs: DataFrame) -> DataFrame:
    """``item_id, doc_id, jaccard`` of the word sets of each row of ``items(item_id, text)`` with each of ``docs(doc_id, text)``.

    Every pair of rows with a common word is there; all others have a similarity
    of 0.  Items are taken in bounded blocks, and documents are not shuffled.
    """
    words = spread(docs.select("doc_id", "text")).select("doc_id", word_set(F.col("text")).alias("dw"))
    schema = f"item_id long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, jaccard double"
    n = max(-(-items.count() // ITEMS), 1)
    out = None
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select(F.col("item_id").cast("long"), word_set(F.coalesce("text", F.lit(""))))
        found = words.mapInArrow(_similarity(["item_id", "doc_id", "jaccard"], [tuple(r) for r in part.collect()]), schema)
        out = found if out is None else out.union(found)
    return out
