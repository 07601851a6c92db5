"""The engine as one object: ingest filings, ask questions, find communities."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quernstone.functions.scalars import asks_metrics, entity_candidates, expanded_query, mentioned, years
from quernstone.functions.tables import QUERY_ALIASES, TICKERS
from quernstone.operators import chunking, communities, extraction, graph, incremental, retrieval
from quernstone.sources import files
from quernstone.versions import Conflict, Store, Version
from quernstone.workspace import is_empty, materialize

SCHEMAS = {
    "chunks": "chunk_id string, text string, section_id string, chunk_seq bigint, token_count bigint, company_ticker string, fiscal_year bigint",
    "edges": "rel string, src_label string, src string, dst_label string, dst string, chunk_id string",
    "nodes": "label string, key string, name string, props map<string,string>, chunk_id string",
    "asked": "chunk_id string",
    "vectors": "chunk_id string, company_ticker string, embedding array<double>",
}
#: What is kept of a chunk that is still there when its filing is read again.
_BY_CHUNK = ("edges", "nodes", "asked", "vectors")
#: Chunks in a batch of extraction; each batch is committed.
BATCH = 500
#: Nodes that the graph visits for a question, and the least score of a ranked chunk.
VISITED, MIN_SCORE = 500, 0.2


def _stopped(at: Version, key: str) -> dict[str, None]:
    """The notes of a run of extraction, taken away."""
    run = at.notes.get(f"run|{key}")
    return {f"run|{key}": None} | ({f"batch|{run}": None} if run else {})


class Engine:
    """State lives in versioned tables under ``home``, in parts by company and year.

    Every change is one version of all tables (``Store``); a question reads one.
    ``extractor`` makes a column of model output from a chunk's text; without
    one there is no graph.  ``embedder`` makes a column of vectors from text;
    without one there is no dense list.  ``scorer`` scores a question and a text.
    """

    def __init__(self, spark: SparkSession, home: str, extractor: Callable[[Column], Column] | None = None, embedder: Callable[[Column], Column] | None = None, scorer: Callable[[Column, Column], Column] = retrieval.lexical_score):
        self.spark, self.home = spark, home.rstrip("/")
        self.extractor, self.embedder, self.scorer = extractor, embedder, scorer
        self.store = Store(spark, self.home, SCHEMAS)

    @property
    def chunks(self) -> DataFrame:
        return self.store.read("chunks")

    @property
    def edges(self) -> DataFrame:
        return self.store.read("edges")

    def _index(self, at: Version) -> retrieval.Bm25Index:
        """The stored BM25 index of a version's chunks; a version without one gets it, if it is still the last."""
        if not at.of("bm25"):
            path = f"data/bm25/{uuid.uuid4().hex}"
            retrieval.build_index(self.store.read("chunks", at), f"{self.home}/{path}")
            try:
                at = self.store.commit(at.swapped("bm25", [], [("all", path)]))
            except Conflict:  # somebody has changed the tables; the index is right for what is read here
                return retrieval.read_index(self.spark, f"{self.home}/{path}")
        return retrieval.read_index(self.spark, f"{self.home}/{at.of('bm25')[0][1]}")

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        return chunks.select("chunk_id", "company_ticker", self.embedder(F.col("text")).cast("array<double>").alias("embedding"))

    def ingest(self, folder: str, ticker: str, year: int) -> None:
        """Read all filings of a folder, chunk them, and replace what is stored of the company and year.

        What was extracted from chunks that are still there stays, that of others
        goes in the same step.
        """
        texts = files.texts(files.of_year(files.filings(self.spark, folder), year)).filter("text IS NOT NULL")
        filings = texts.select(F.lit(ticker).alias("company_ticker"), F.lit(year).cast("bigint").alias("fiscal_year"), F.col("path").alias("filing"), "text")
        found = chunking.table_chunks(chunking.sections(filings)).dropDuplicates(["chunk_id"])
        key, base = f"{ticker}|{year}", self.store.current()
        after = base.swapped("chunks", base.of("chunks", key), [self.store.stage("chunks", found, key)]).swapped("bm25", base.of("bm25"), []).noted(**_stopped(base, key))
        here = self.store.read("chunks", after, key)
        for table in _BY_CHUNK:
            if old := base.of(table, key):
                kept = self.store.read(table, base, key).join(here.select("chunk_id"), "chunk_id", "left_semi")
                after = after.swapped(table, old, [self.store.stage(table, kept, key)])
        if self.embedder is not None:
            fresh = incremental.new_rows(here, self.store.read("vectors", after, key), "chunk_id")
            after = after.swapped("vectors", [], [self.store.stage("vectors", self._embedded(fresh), key)])
        self.store.commit(after)
        if self.extractor is not None:
            self.extract(ticker, year)

    def extract(self, ticker: str, year: int, batch: int = BATCH) -> None:
        """Ask the extractor about the chunks of a company and year that it has not been asked about.

        They are a stream of files of ``batch`` chunks.  The triplets of a batch,
        that its chunks have been asked about, triplets or not, and its number are
        one commit, so that a run that breaks off goes on behind its last batch,
        and a batch that the stream repeats is left out.
        """
        key, base = f"{ticker}|{year}", self.store.current()
        run = base.notes.get(f"run|{key}")
        if run is None:
            run = uuid.uuid4().hex
            open_ = incremental.new_rows(self.store.read("chunks", base, key), self.store.read("asked", base, key), "chunk_id")
            if is_empty(open_):
                return
            open_.coalesce(1).write.option("maxRecordsPerFile", batch).parquet(f"{self.home}/runs/{run}/chunks")
            self.store.commit(base.noted(**{f"run|{key}": run}))

        def store(rows: DataFrame, number: int) -> None:
            before = self.store.current()
            if before.notes.get(f"run|{key}") != run or int(before.notes.get(f"batch|{run}", -1)) >= number:
                return
            asked = materialize(rows.withColumn("output", self.extractor(F.substring("text", 1, extraction.SINGLE_CHARS))), "asked")  # the model answers once
            typed = materialize(extraction.typed(extraction.parse(asked), asked), "typed")
            ends = [typed.select(F.col(f"{e}_label").alias("label"), F.col(e).alias("key"), F.col(f"{e}_name").alias("name"), F.col(f"{side}_props").alias("props"), "chunk_id") for e, side in (("src", "source"), ("dst", "target"))]
            after = before
            for table, made in (("edges", typed), ("nodes", ends[0].union(ends[1])), ("asked", asked)):
                after = after.swapped(table, [], [self.store.stage(table, made, key)])
            self.store.commit(after.noted(**{f"batch|{run}": str(number)}))

        stream = self.spark.readStream.schema(SCHEMAS["chunks"]).option("maxFilesPerTrigger", 1).parquet(f"{self.home}/runs/{run}/chunks")
        stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{self.home}/runs/{run}/state").trigger(availableNow=True).start().awaitTermination()
        done = self.store.current()
        self.store.commit(done.noted(**_stopped(done, key)))

    def ingest_all(self, config: str, folder_of: Callable[[str, int], str]) -> DataFrame:
        """Ingest every configured pair without chunks; returns the pairs that still miss them."""
        wanted = files.config(self.spark, config)
        gaps = lambda: incremental.missing_pairs(wanted.select("company_ticker"), wanted.select("fiscal_year"), self.chunks).filter("state = 'missing'")
        for pair in gaps().collect():  # the configuration's pairs, a short list
            self.ingest(folder_of(pair["company_ticker"], pair["fiscal_year"]), pair["company_ticker"], pair["fiscal_year"])
        return gaps()

    def purge(self, ticker: str, year: int) -> None:
        """Remove a company and year from all tables in one step, and what other filings say about its metrics.

        Only the other parts that hold such an edge or node are written again.
        """
        key, base, metrics = f"{ticker}|{year}", self.store.current(), f"{ticker}_{year}_"
        after = base.swapped("bm25", base.of("bm25"), []).noted(**_stopped(base, key))
        for table in ("chunks", *_BY_CHUNK):
            after = after.swapped(table, base.of(table, key), [])
        for table, column in (("edges", "dst"), ("nodes", "key")):
            others = [p for p in after.of(table)]
            if not others:
                continue
            hit = self.store.read(table, after).filter(F.col(column).startswith(metrics)).select(F.col("_metadata.file_path").alias("path")).distinct().collect()  # files, not rows
            for part in others:
                if any(f"/{part[1]}/" in r["path"] for r in hit):
                    left = self.store.read(table, Version(parts={table: [part]})).filter(~F.col(column).startswith(metrics))
                    after = after.swapped(table, [part], [self.store.stage(table, left, part[0])])
        self.store.commit(after)

    def query(self, questions: list[str], k: int = 5, tickers: tuple[str, ...] = TICKERS, min_score: float = MIN_SCORE) -> dict[str, DataFrame]:
        """``ranked, contexts, citations, facts, metrics, metrics_table, tickers``: the whole retrieval for a batch of questions.

        Dense search keeps to the companies that a question names by word; entities
        are those of the question with the synonyms of its metrics.
        """
        at = self.store.current()
        asked = self.spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")
        asked = asked.withColumn("tickers", mentioned(F.col("question"), QUERY_ALIASES, list(tickers)))
        chunks, edges = self.store.read("chunks", at), self.store.read("edges", at)
        wide = asked.select("query_id", expanded_query(F.col("question")).alias("question"), "tickers")
        hits = retrieval.search(self._index(at), wide).select("query_id", F.lit("sparse").alias("source"), "chunk_id", "rank")
        if self.embedder is not None:
            asking = wide.select("query_id", self.embedder(F.col("question")).cast("array<double>").alias("query_vector"), F.col("tickers").alias("only"))
            near = retrieval.knn(self.store.read("vectors", at), asking, by="company_ticker")
            hits = hits.unionByName(near.select("query_id", F.lit("dense").alias("source"), "chunk_id", "rank"))
        nodes = materialize(self.nodes(at), "nodes")
        candidates = wide.select("query_id", F.explode(entity_candidates(F.col("question"))).alias("candidate"))
        starts = materialize(graph.find_entities(nodes.select("label", "key", "name"), candidates).select("query_id", "label", "key").distinct(), "starts")
        # Full tickers: those that the words name, and those of the companies that were found.
        companies = starts.filter("label = 'Company'")
        matched = companies.groupBy("query_id").agg(F.collect_set("key").alias("found"))
        named = F.array_sort(F.array_union("tickers", F.coalesce("found", F.array().cast("array<string>"))))
        asked = asked.join(matched, "query_id", "left").withColumn("tickers", named).drop("found")
        reached = graph.hops(edges.drop("chunk_id"), starts, most=VISITED)
        cited = graph.mentions(edges).select("chunk_id", "label", "key")
        hits = hits.unionByName(graph.traverse(reached, cited).select("query_id", F.lit("graph").alias("source"), "chunk_id", "rank"))
        fused = retrieval.rrf(hits).join(chunks, "chunk_id")
        kept = retrieval.keep_first(retrieval.ground(fused, asked.select("query_id", "tickers")))
        ranked = retrieval.rerank(kept.join(asked.select("query_id", "question"), "query_id"), k, min_score, scorer=self.scorer)
        metrics = materialize(self._metrics(asked, nodes, edges, chunks), "metrics")
        return {
            "ranked": ranked,
            "contexts": retrieval.contexts(ranked.join(chunks, "chunk_id")),
            "citations": retrieval.citations(ranked, metrics.filter("chunk_id IS NOT NULL").select("query_id", "chunk_id")),
            "facts": graph.facts(edges.drop("chunk_id"), companies),
            "metrics": metrics,
            "metrics_table": graph.markdown_table(metrics, ["ticker", "fiscal_year", "metric_id"], ("query_id",)),
            "tickers": asked.select("query_id", "tickers", years(F.col("question")).alias("years"), asks_metrics(F.col("question")).alias("asks_metrics")),
        }

    def nodes(self, at: Version | None = None) -> DataFrame:
        """``label, key, name, value, unit``: each node with the last non-null name, value and unit by chunk."""
        rows = self.store.read("nodes", at or self.store.current())
        said = rows.select("label", "key", "name", *(F.nullif(F.trim(F.col("props")[c]), F.lit("")).alias(c) for c in ("value", "unit")), "chunk_id")
        return graph.merge_last(said, ["label", "key"], "chunk_id")

    def _metrics(self, asked: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, k: int = 20) -> DataFrame:
        """The metrics that questions about metrics may mean, by their tickers and years, each with its first citing chunk."""
        parts = F.split("key", "_")
        known = nodes.filter("label = 'FinancialMetric'").select(F.col("key").alias("metric_id"), parts[0].alias("ticker"), F.get(parts, F.lit(1)).try_cast("bigint").alias("fiscal_year"), "name", "value", "unit")
        wanted = asked.filter(asks_metrics(F.col("question"))).select("query_id", F.explode("tickers").alias("ticker"), years(F.col("question")).alias("years"))
        rows = known.join(wanted, "ticker").filter((F.size("years") == 0) | F.array_contains("years", F.col("fiscal_year"))).drop("years")
        rows = retrieval.top(rows, ["query_id"], [F.asc("ticker"), F.asc("fiscal_year"), F.asc("metric_id")], k)
        first = edges.filter("dst_label = 'FinancialMetric'").groupBy(F.col("dst").alias("metric_id")).agg(F.min("chunk_id").alias("chunk_id"))
        return rows.join(first, "metric_id", "left").join(chunks.select("chunk_id", "section_id"), "chunk_id", "left").select("query_id", "metric_id", "ticker", "fiscal_year", "name", "value", "unit", "section_id", "chunk_id")

    def communities(self, resolution: float = 1.0) -> DataFrame:
        """The largest communities of the graph by modularity."""
        pairs = materialize(self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).filter("a <> b").distinct(), "pairs")
        return graph.summaries(communities.modular(pairs, resolution), pairs)
