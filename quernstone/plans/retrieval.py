"""Retrieval queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.functions.scalars import expanded_query, mentioned
from quernstone.operators import graph, retrieval as r, vector_cells
from quernstone.plans import graph as graph_plans
from quernstone.sources import tables
from quernstone.workspace import materialize, new_path

#: Vectors of a stored cell; the given tables are small, so that they still make several cells.
CELL_ROWS = 200
#: A fixed batch of questions.
QUESTIONS = (
    (1, "that and the onesen the revenue zzz"),
    (2, "der die das und nicht src3"),
    (3, "Que de la ciónes net income eps src5 SRC7"),
)


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "query_id long, question string")


def _values() -> str:
    return ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_BM25 = f"""
q AS (SELECT col0::BIGINT AS query_id, col1 AS question FROM (VALUES {_values()})),
words AS (SELECT doc_id AS chunk_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-zA-Z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '') AS words FROM documents),
lengths AS (SELECT chunk_id, len(words) AS dl FROM words),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(words) AS term FROM words) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df, stats),
mean AS (SELECT avg(raw) AS mean FROM raw),
idf AS (SELECT term, CASE WHEN raw < 0 THEN mean * 0.25::DOUBLE ELSE raw END AS idf FROM raw, mean),
asked AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(question), '[^a-zA-Z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')) AS term FROM q) GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, sum(qn * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM asked JOIN idf USING (term) JOIN post USING (term) JOIN lengths USING (chunk_id), stats GROUP BY query_id, chunk_id),
bm25 AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20)"""


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """BM25, the best 20 chunks of each question."""
    return _rounded(r.bm25(tables.chunks(spark, sf), questions(spark)), "score")


_KNN = """
v AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS e, label FROM embeddings),
qv AS (SELECT col0::BIGINT AS query_id, e AS qe FROM (VALUES (1, 0), (2, 7), (3, 20)) JOIN v ON v.chunk_id = col1),
dist AS (SELECT query_id, chunk_id, label, list_sum(list_transform(list_zip(e, qe), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM v, qv),
knn AS (SELECT * FROM (SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM dist) WHERE rank <= 15)"""


def _query_vectors(vectors: DataFrame) -> DataFrame:
    ids = F.create_map(F.lit(0), F.lit(1), F.lit(7), F.lit(2), F.lit(20), F.lit(3))
    return vectors.filter(F.col("chunk_id").isin(0, 7, 20)).select(F.element_at(ids, F.col("chunk_id").cast("int")).cast("long").alias("query_id"), F.col("embedding").alias("query_vector"))


def dense_knn(spark: SparkSession, sf: str) -> DataFrame:
    """Exact kNN, 15 nearest by squared L2."""
    v = tables.vectors(spark, sf)
    return _rounded(r.knn(v, _query_vectors(v)), "distance")


def dense_knn_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    """Exact kNN among the rows of some labels; the filter reaches the scan."""
    v = tables.vectors(spark, sf)
    return _rounded(r.knn(v, _query_vectors(v), keep=F.col("label").isin(1, 3, 5)), "distance")


def dense_knn_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The answers of ``dense_knn`` from vectors stored by cells, where cells that cannot hold one are not read."""
    v, path = tables.vectors(spark, sf), new_path(spark, "vectors")
    vector_cells.store(v, path, ["label", "chunk_id"], rows=CELL_ROWS)
    return _rounded(vector_cells.search(spark, path, _query_vectors(v))[0], "distance")


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """The lists of BM25, kNN and graph traversal, with their source."""
    chunks, v = tables.chunks(spark, sf), tables.vectors(spark, sf)
    sparse = r.bm25(chunks, questions(spark)).select("query_id", F.lit("sparse").alias("source"), "chunk_id", "rank")
    dense = r.knn(v, _query_vectors(v)).select("query_id", F.lit("dense").alias("source"), "chunk_id", "rank")
    return dense.unionByName(sparse)


_FUSED = """
hits AS (SELECT query_id, 'dense' AS source, chunk_id, rank FROM knn UNION ALL SELECT query_id, 'sparse', chunk_id, rank FROM bm25),
fused AS (SELECT * FROM (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (rank + 60)) AS rrf_score, count(*) AS n_lists, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0::DOUBLE / (rank + 60)), 12) DESC, min((source, rank)), chunk_id) AS rank FROM hits GROUP BY query_id, chunk_id) WHERE rank <= 20)"""


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    """Reciprocal rank fusion of the dense and sparse lists."""
    return _rounded(r.rrf(_hits(spark, sf)), "rrf_score")


def _tickers(spark: SparkSession, sf: str) -> DataFrame:
    symbols = [f"src{i}" for i in range(20)]  # the synthetic sources stand for configured tickers
    return questions(spark).select("query_id", mentioned(F.col("question"), {}, symbols).alias("tickers"))


def _grounded(spark: SparkSession, sf: str) -> DataFrame:
    fused = r.rrf(_hits(spark, sf)).join(tables.chunks(spark, sf), "chunk_id")
    return r.keep_first(r.ground(fused, _tickers(spark, sf)))


def rrf_ground_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Fused candidates of the named tickers, the first of each ticker and section."""
    return _rounded(_grounded(spark, sf).select("query_id", "chunk_id", "company_ticker", "section_id", "rank", "rrf_score"), "rrf_score")


_ITEMS = "['Item 1','Item 1A','Item 1B','Item 2','Item 3','Item 4','Item 5','Item 6','Item 7','Item 7A','Item 8','Item 9','Item 9A','Item 9B','Item 10','Item 11','Item 12','Item 13','Item 14','Item 15','Item 16']"
CHUNKS = f"chunks AS (SELECT doc_id AS chunk_id, text, source AS company_ticker, 2024 + doc_id % 2 AS fiscal_year, {_ITEMS}[doc_id % 21 + 1] AS section_id FROM documents)"
_GROUNDED = f"""
{CHUNKS},
named AS (SELECT query_id, list_distinct(regexp_extract_all(lower(question), '\\bsrc(?:1[0-9]|[0-9])\\b')) AS tickers FROM q),
grounded AS (SELECT * FROM (SELECT f.query_id, chunk_id, company_ticker, section_id, rank, rrf_score, row_number() OVER (PARTITION BY f.query_id, company_ticker, section_id ORDER BY rank) AS k FROM fused f JOIN chunks USING (chunk_id) JOIN named USING (query_id) WHERE len(tickers) = 0 OR list_contains(tickers, company_ticker)) WHERE k = 1)"""


def mmr_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Re-ranking of the BM25 list by score and diversity."""
    hits = r.bm25(tables.chunks(spark, sf), questions(spark)).join(tables.chunks(spark, sf).select("chunk_id", "text"), "chunk_id").join(questions(spark), "query_id")
    return _rounded(r.rerank(hits, min_score=0.0), "score")


def sigmoid_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Sigmoid scores of a lexical scorer, at least 0.3, in order."""
    hits = r.bm25(tables.chunks(spark, sf), questions(spark)).join(tables.chunks(spark, sf).select("chunk_id", "text"), "chunk_id").join(questions(spark), "query_id")
    scored = hits.withColumn("score", F.round(r.sigmoid(r.lexical_score(F.col("question"), F.col("text"))), 6))
    return scored.filter("score >= 0.3").select("query_id", "chunk_id", "score")


def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Word-set similarity of each benchmark item with every chunk that shares a word, long or short."""
    items, docs = tables.table(spark, sf, "benchmark"), tables.table(spark, sf, "documents")
    return _rounded(r.set_similarity(items, docs), "jaccard")


#: Metrics that turns of a conversation ask for, one after the other.
ASKED_METRICS = ("revenue", "Net Income and EPS", "operating income", "total assets", "headcount")


def query_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of all conversations, each asking for a metric, with the synonyms of the metrics they name."""
    metric = F.element_at(F.array(*map(F.lit, ASKED_METRICS)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(ASKED_METRICS))) + 1).cast("int"))
    asked = tables.table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws(" ", "text", metric).alias("question"))
    return asked.select("conv_id", "turn", expanded_query(F.col("question")).alias("expanded"))


def hybrid_query(spark: SparkSession, sf: str) -> DataFrame:
    """The whole retrieval: BM25, kNN and graph lists fused, grounded, deduplicated, re-ranked, with facts and context."""
    chunks, q = tables.chunks(spark, sf), questions(spark)
    names = tables.table(spark, sf, "supplier").select(F.lit("Company").alias("label"), F.col("s_name").alias("key"), F.right("s_name", F.lit(4)).alias("end"))
    starts = names.join(q.select("query_id", F.lpad(F.col("query_id").cast("string"), 4, "0").alias("end")), "end").select("query_id", "label", "key")
    reached = graph.hops(graph_plans.edges_of(spark, sf), starts)
    cited = chunks.select(F.lit("BusinessSegment").alias("label"), F.concat(F.lit("Brand#"), (11 + F.col("chunk_id") % 45).cast("string")).alias("key"), "chunk_id")
    linked = graph.traverse(reached, cited).select("query_id", F.lit("graph").alias("source"), "chunk_id", "rank")
    expanded = q.select("query_id", expanded_query(F.col("question")).alias("question"))
    sparse = r.bm25(chunks, expanded).select("query_id", F.lit("sparse").alias("source"), "chunk_id", "rank")
    v = tables.vectors(spark, sf)
    dense = r.knn(v, _query_vectors(v)).select("query_id", F.lit("dense").alias("source"), "chunk_id", "rank")
    fused = materialize(r.rrf(dense.unionByName(linked).unionByName(sparse)), "fused")  # 20 rows a question
    kept = r.keep_first(r.ground(fused.join(chunks, "chunk_id"), _tickers(spark, sf))).join(q, "query_id")
    ranked = materialize(r.rerank(kept, min_score=0.0), "ranked")  # a few rows, used twice
    found = graph.facts(tables.graph_edges(spark, sf, starts.select(F.col("label").alias("src_label"), F.col("key").alias("src"))), starts).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("fact")), "; ").alias("facts"))
    blocks = r.contexts(ranked.join(chunks, "chunk_id"))
    return ranked.join(blocks, "query_id").join(found, "query_id", "left").select("query_id", "position", "chunk_id", F.round("score", 6).alias("score"), F.sha1(F.col("context").cast("binary")).alias("context_sha1"), "facts")


QUERIES = {
    "bm25_topk": bm25_topk,
    "dense_knn": dense_knn,
    "dense_knn_prefilter": dense_knn_prefilter,
    "dense_knn_stored": dense_knn_stored,
    "rrf_fuse": rrf_fuse,
    "rrf_ground_dedupe": rrf_ground_dedupe,
    "mmr_rerank": mmr_rerank,
    "sigmoid_threshold": sigmoid_threshold,
    "jaccard_pairs": jaccard_pairs,
    "query_expansion": query_expansion,
    "hybrid_query": hybrid_query,
}
_SETS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


def _mmr(k: int = 5) -> str:
    """The greedy choice, ``k`` steps written out, of ``cand(query_id, question, chunk_id, text, rank)``."""
    sets, share = _SETS.format, "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"
    out = f"""ws AS (SELECT query_id, chunk_id, rank, {sets("question")} AS a, {sets("text")} AS b FROM cand),
sc AS (SELECT query_id, chunk_id, rank, b, 1 / (1 + exp(-(8 * {share.format("a", "b")} - 1))) AS score FROM ws),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS i, count(*) OVER (PARTITION BY query_id) AS n FROM sc),
sim AS (SELECT x.query_id, x.i, y.i AS j, {share.format("x.b", "y.b")} AS near FROM pl x JOIN pl y USING (query_id)),
m1 AS (SELECT query_id, i, 1::BIGINT AS position FROM pl WHERE i = 1)"""
    for step in range(2, k + 1):
        out += f""",
m{step} AS (FROM m{step - 1} UNION ALL SELECT query_id, i, {step}::BIGINT FROM (SELECT pl.query_id, pl.i, CASE WHEN n <= {k} THEN score ELSE 0.7::DOUBLE * score - (1 - 0.7::DOUBLE) * max(near) END AS worth
  FROM pl JOIN sim ON sim.query_id = pl.query_id AND sim.i = pl.i JOIN m{step - 1} c ON c.query_id = sim.query_id AND c.i = sim.j
  WHERE NOT EXISTS (FROM m{step - 1} d WHERE d.query_id = pl.query_id AND d.i = pl.i) GROUP BY pl.query_id, pl.i, score, n) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY worth DESC, i) = 1)"""
    return out + f""",
mmr AS (SELECT query_id, chunk_id, score, position FROM m{k} JOIN pl USING (query_id, i))"""


_EXPANDED = """concat_ws(' ', question, CASE WHEN contains(lower(question), 'revenue') THEN 'net sales total net sales sales revenues total revenues net revenue' END, CASE WHEN contains(lower(question), 'net income') THEN 'net earnings profit earnings' END,
        CASE WHEN contains(lower(question), 'operating income') THEN 'operating profit income from operations' END, CASE WHEN contains(lower(question), 'eps') THEN 'earnings per share diluted eps' END, CASE WHEN contains(lower(question), 'total assets') THEN 'assets' END)"""
#: The hybrid query's lists, from the questions' starts to what is re-ranked.
_HYBRID = f"""{_BM25.replace("FROM (VALUES", f", {_EXPANDED.replace('question', 'col1')} AS expanded FROM (VALUES").replace("lower(question)", "lower(expanded)")}, {_KNN},
{graph_plans.EDGES},
nd AS (SELECT src_label AS label, src AS key FROM e UNION SELECT dst_label, dst FROM e),
mv AS (SELECT DISTINCT * FROM e QUALIFY row_number() OVER (PARTITION BY rel, src_label, src ORDER BY dst) <= 50),
d1 AS (SELECT query_id, label, key, 1 AS depth FROM nd JOIN q ON label = 'Company' AND ends_with(key, lpad(query_id::VARCHAR, 4, '0'))),
d2 AS (SELECT DISTINCT query_id, dst_label AS label, dst AS key, 2 AS depth FROM d1 JOIN mv ON label = src_label AND key = src),
d3 AS (SELECT DISTINCT query_id, dst_label AS label, dst AS key, 3 AS depth FROM d2 JOIN mv ON label = src_label AND key = src),
h AS (SELECT query_id, label, key, min(depth) AS depth FROM (FROM d1 UNION ALL FROM d2 UNION ALL FROM d3) GROUP BY ALL),
ct AS (SELECT 'BusinessSegment' AS label, 'Brand#' || (11 + doc_id % 45) AS key, doc_id AS chunk_id FROM documents),
linked AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY min(depth), chunk_id) AS rank FROM h JOIN ct USING (label, key) GROUP BY query_id, chunk_id QUALIFY rank <= 20),
{_FUSED.replace("UNION ALL SELECT query_id, 'sparse'", "UNION ALL SELECT query_id, 'graph', chunk_id, rank FROM linked UNION ALL SELECT query_id, 'sparse'")}, {_GROUNDED},
cand AS (SELECT query_id, question, chunk_id, text, rank FROM grounded JOIN q USING (query_id) JOIN documents ON doc_id = chunk_id), {_mmr()},
ctx AS (SELECT query_id, sha1(string_agg('[' || position || '] (' || company_ticker || ' ' || fiscal_year || ', ' || section_id || ')' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY position)) AS context_sha1 FROM mmr JOIN chunks USING (chunk_id) GROUP BY query_id),
fa AS (SELECT DISTINCT query_id, rel, src, dst FROM e JOIN d1 ON src = key WHERE rel IN ('OPERATES_IN', 'COMPETES_WITH')),
fb AS (SELECT DISTINCT query_id, src || ' --' || rel || '--> ' || dst AS fact FROM (FROM fa QUALIFY row_number() OVER (PARTITION BY query_id, rel, src ORDER BY dst) <= 10)),
fc AS (SELECT query_id, string_agg(fact, '; ' ORDER BY fact) AS facts FROM (FROM fb QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fact) <= 20) GROUP BY query_id)"""
SQL = {
    "bm25_topk": f"WITH {_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm25",
    "dense_knn": f"WITH {_KNN} SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM knn",
    "dense_knn_stored": f"WITH {_KNN} SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM knn",
    "dense_knn_prefilter": f"WITH {_KNN} SELECT * FROM (SELECT query_id, chunk_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM dist WHERE label IN (1, 3, 5)) WHERE rank <= 15",
    "rrf_fuse": f"WITH {_BM25}, {_KNN}, {_FUSED} SELECT query_id, chunk_id, round(rrf_score, 6) AS rrf_score, n_lists, rank FROM fused",
    "rrf_ground_dedupe": f"WITH {_BM25}, {_KNN}, {_FUSED}, {_GROUNDED} SELECT query_id, chunk_id, company_ticker, section_id, rank, round(rrf_score, 6) AS rrf_score FROM grounded",
    "mmr_rerank": f"WITH {_BM25}, cand AS (SELECT query_id, question, chunk_id, text, rank FROM bm25 JOIN q USING (query_id) JOIN documents ON doc_id = chunk_id), {_mmr()} SELECT query_id, chunk_id, round(score, 6) AS score, position FROM mmr",
    "sigmoid_threshold": f"""WITH {_BM25}, s AS (SELECT query_id, chunk_id, {_SETS.format("question")} AS a, {_SETS.format("d.text")} AS b FROM bm25 JOIN q USING (query_id) JOIN documents d ON doc_id = chunk_id),
        j AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END AS j FROM s)
        SELECT query_id, chunk_id, round(1 / (1 + exp(-(8 * j - 1))), 6) AS score FROM j WHERE round(1 / (1 + exp(-(8 * j - 1))), 6) >= 0.3""",
    "jaccard_pairs": f"""WITH i AS (SELECT item_id, {_SETS.format("text")} AS iw FROM benchmark), d AS (SELECT doc_id, {_SETS.format("text")} AS dw FROM documents),
        p AS (SELECT item_id, doc_id, len(iw) + len(dw) AS n, len(list_intersect(iw, dw)) AS c FROM i, d)
        SELECT item_id, doc_id, round(c::DOUBLE / (n - c), 6) AS jaccard FROM p WHERE c > 0""",
    "hybrid_query": f"WITH {_HYBRID} SELECT query_id, position, chunk_id, round(score, 6) AS score, context_sha1, facts FROM mmr JOIN ctx USING (query_id) LEFT JOIN fc USING (query_id)",
    "query_expansion": f"""WITH q AS (SELECT conv_id, turn, concat_ws(' ', text, {list(ASKED_METRICS)}[(conv_id + turn) % {len(ASKED_METRICS)} + 1]) AS question FROM conversations)
        SELECT conv_id, turn, {_EXPANDED} AS expanded FROM q""",
}
