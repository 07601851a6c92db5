"""Ingestion queries: chunks, sections, HTML, extraction, and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.functions import table_functions
from quernstone.functions.scalars import skippable
from quernstone.functions.tables import SECTION_ITEMS
from quernstone.operators import chunking, extraction, incremental as inc
from quernstone.plans.retrieval import CHUNKS
from quernstone.sources import files, tables
from quernstone.workspace import spread

#: Line beginnings that become headings, contents rows and prose that looks like a heading.
HEADED = (("\nI", "\n## item 7A I"), ("\nA", "\nItem 1. A"), ("\nO", "\nItem 9C | O"), ("\nE", "\nITEM 8 | E"), ("\nL", "\nItem 16 of L"))
#: A filing of each kind: text before the document's lines, and after them.
WRAPPED = (
    ("preamble", ""),
    ("<SEC>\n<DOCUMENT>\n<TYPE>EX-21\n<TEXT>\nItem 1 exhibit\n{text}\n{text}\n{text}</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>10-K\n<TEXT>\n", "\n</TEXT>\n</DOCUMENT>"),
    ("<document>\n<type> 10-K/A\n<text>Item 2\nshort</text>\n<text>\nItem 3. First\n", "\nlast line, never closed"),
    ("<DOCUMENT>\n<TYPE>EX-1\n<TEXT>\nItem 5\nx</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>EX-2\n<TEXT>", "</TEXT></DOCUMENT>"),
)
#: What a model says about a customer: ``{n}`` name, ``{s}`` segment, ``{v}`` value, ``{b}`` the chunk five before.
SAID = (
    '<think>hm {{</think>```json\n{{"triplets": [{{"source": {{"name": "{n}"}}, "relation": "operates_in", "target": {{"name": "{s}"}}}}]}}\n```',
    '{{"triplets": [["{n}", "competes_with", "Rival {n}"], ["too short"], {{"source_entity": "{n}", "relation": "REPORTED_METRIC", "target_entity": {{"name": "Net Income", "value": "{v}", "year": "2023"}}}}',
    'Here you are: {{"source": {{"{n}"}}, "relation": "operates_in", "target": {{"{s}"}}}} done',
    '[{{"source": "{n}", "relation": "impacts_revenue", "target": "Revenue"}}, {{"source": "x", "relation": "likes", "target": "y"}}]',
    "nothing of {n} in braces",
    '{{"results": [{{"chunk_id": "{b}", "triplets": [["{s}", "mitigates_risk", "Rates"]]}}]}}',
    '{{"source": "{n}", "relation": "competes_with", "target": " {n} "}}',
    '{{"triples": [["{n}", "competes_with", "Others"], ["Facebook", "competes_with", "Meta Platforms"], ["{n}", "reported_metric", {{"name": "EPS", "value": "{v}", "unit": "USD"}}]]}}',
)


def filings(spark: SparkSession, sf: str) -> DataFrame:
    """``filing, company_ticker, fiscal_year, text``: each document as a raw filing of one of four kinds, with headings."""
    text = F.coalesce("text", F.lit(""))
    lines = F.concat(F.lit("\n"), text)
    for old, new in HEADED:
        lines = F.replace(lines, F.lit(old), F.lit(new))
    kinds = [F.concat(F.replace(F.lit(before), F.lit("{text}"), text), lines, F.lit(after)) for before, after in WRAPPED]
    kind = F.coalesce(*[F.when(F.col("chunk_id") % len(kinds) == i, x) for i, x in enumerate(kinds)])
    return tables.chunks(spark, sf).select(F.col("chunk_id").alias("filing"), "company_ticker", "fiscal_year", kind.alias("text"))


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    """``chunk_id, company_ticker, fiscal_year, text, output``: a chunk on each customer, and what a model said of it."""
    k, value = F.col("c_custkey"), F.concat(F.lit("7"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    said = [x.format(n="%1$s", s="%2$s", v="%3$s", b="%4$s") for x in SAID]
    parts = ("c_name", "c_mktsegment", value, (k - 5).cast("string"))
    text = F.format_string("It was founded in 2018. In %d it earned %s; 2026 is another matter.", 2019 + k % 7, value)
    output = F.coalesce(*[F.when(k % len(said) == i, F.format_string(x, *parts)) for i, x in enumerate(said)])
    return tables.table(spark, sf, "customer").select(k.cast("string").alias("chunk_id"), F.concat(F.lit("C"), k.cast("string")).alias("company_ticker"), (2024 + k % 2).alias("fiscal_year"), text.alias("text"), output.alias("output"))


def chunk_window(spark: SparkSession, sf: str) -> DataFrame:
    """Sliding windows of 600 words with ids over all documents."""
    out = chunking.windows(tables.chunks(spark, sf).withColumnRenamed("chunk_id", "doc_id"))
    return out.select("doc_id", "chunk_seq", "token_count", "chunk_id")


def chunk_table_function(spark: SparkSession, sf: str) -> DataFrame:
    """The same windows by SQL's table function."""
    table_functions.register(spark)
    tables.chunks(spark, sf).withColumnRenamed("chunk_id", "doc_id").createOrReplaceTempView("chunk_table_function_rows")
    return spark.sql("SELECT doc_id, chunk_seq, token_count, chunk_id FROM chunks(TABLE(chunk_table_function_rows))")


def _main(spark: SparkSession, sf: str) -> DataFrame:
    return filings(spark, sf).withColumn("text", chunking.main_document(F.col("text")))


def _digest(column: str) -> list:
    return [F.length(column).cast("bigint").alias("n_chars"), F.sha1(F.col(column).cast("binary")).alias("sha1")]


def main_document(spark: SparkSession, sf: str) -> DataFrame:
    """The main document of each filing."""
    return _main(spark, sf).select("filing", "company_ticker", "fiscal_year", *_digest("text"))


def section_split(spark: SparkSession, sf: str) -> DataFrame:
    """The sections of each filing."""
    return chunking.sections(_main(spark, sf)).select("filing", "company_ticker", "fiscal_year", "section_no", "section_id", *_digest("content"))


def table_aware_chunk(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all documents, cut around their tables."""
    out = chunking.table_chunks(tables.chunks(spark, sf).withColumnRenamed("text", "content").drop("chunk_id"))
    return out.select("company_ticker", "fiscal_year", "section_id", "chunk_seq", "token_count", "chunk_id")


def html_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The visible text of all pages."""
    out = chunking.clean_html(tables.table(spark, sf, "pages").select("page_id", "html"))
    return out.select("page_id", F.length("content").cast("bigint").alias("n_chars"), F.sha1(F.col("content").cast("binary")).alias("sha1"))


def skippable_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks not worth extracting from; the section name stands in the text's first line."""
    rows = tables.chunks(spark, sf).withColumn("section", F.when(F.col("chunk_id") % 3 == 0, "Signatures").otherwise(F.col("section_id")))
    return rows.filter(skippable(F.col("text"), F.col("section"))).select("chunk_id", "section")


def filing_year_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Filings of 2024 by accession number; paths without one stay."""
    rows = tables.table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 7 == 0, "loose.txt").otherwise(F.format_string("/f/%010d-%02d-%06d/full.txt", F.col("o_custkey"), (F.col("o_orderkey") % 4 + 22).cast("int"), F.col("o_orderkey"))).alias("path"))
    return files.of_year(rows, 2024).groupBy("path").agg(F.count("*").alias("n"))


def triplet_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Model outputs on all customers parsed, repaired, typed and keyed."""
    rows = spread(outputs(spark, sf))
    return extraction.typed(extraction.parse(rows), rows).select("chunk_id", "rel", "src_label", "src", "dst_label", "dst")


def json_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Model outputs on all customers parsed, before typing."""
    parsed = extraction.parse(spread(outputs(spark, sf)))
    props = [F.col("target_props")[k].alias(k) for k in ("value", "unit", "year")]
    return parsed.select("chunk_id", "relation", "source", "target", *props)


def incremental_append(spark: SparkSession, sf: str) -> DataFrame:
    """Documents not stored yet, where two of three are."""
    docs = tables.chunks(spark, sf).select("chunk_id", "company_ticker")
    return inc.new_rows(docs, docs.filter("chunk_id % 3 <> 0"), "chunk_id")


def pending_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks by ticker, year and whether the cache holds them."""
    docs = tables.chunks(spark, sf).select("chunk_id", "company_ticker", "fiscal_year")
    return inc.pending(docs, docs.filter("chunk_id % 4 = 1")).groupBy("company_ticker", "fiscal_year", "state").agg(F.count("*").alias("n"))


def purge_pair(spark: SparkSession, sf: str) -> DataFrame:
    """What is left by ticker and year without one pair."""
    return inc.purge(tables.chunks(spark, sf), "src1", 2025).groupBy("company_ticker", "fiscal_year").agg(F.count("*").alias("n"))


def missing_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Configured pairs without chunks, and pairs with chunks that are not configured."""
    docs = tables.chunks(spark, sf)
    companies = docs.select("company_ticker").filter("company_ticker <> 'src3'").union(spark.createDataFrame([("srcX",)], "company_ticker string"))
    return inc.missing_pairs(companies, spark.createDataFrame([(2024,), (2025,)], "fiscal_year long"), docs.filter("chunk_id % 5 <> 2 OR company_ticker <> 'src7'"))


def upsert_last_non_null(spark: SparkSession, sf: str) -> DataFrame:
    """For each user the last value and the last non-null type, column by column."""
    from quernstone.operators.graph import merge_last

    events = tables.table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 2 == 0, F.round("value", 4)).alias("value"))
    return merge_last(events, ["user_id"], "event_id")


def upsert_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The last whole event of each user."""
    from quernstone.operators.graph import merge_rows

    events = tables.table(spark, sf, "events").select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))
    return merge_rows(events, ["user_id"], "event_id")


def progress_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The latest state of each user."""
    events = tables.table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return inc.latest(events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def ttl_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each type that are younger than three days at a fixed moment."""
    events = tables.table(spark, sf, "events")
    fresh = inc.fresh(events, F.col("ts"), F.lit("2024-01-20 00:00:00").cast("timestamp"), 3 * 86400)
    return fresh.groupBy("event_type").agg(F.count("*").alias("n"))


def stale_locks(spark: SparkSession, sf: str) -> DataFrame:
    """Locks older than six hours at a fixed moment."""
    locks = tables.table(spark, sf, "events").filter("event_type = 'signup'").select("user_id", F.col("ts").alias("at"), "event_id")
    return inc.stale_locks(locks, F.lit("2024-01-15 12:00:00").cast("timestamp")).select("user_id", "event_id")


def config_union(spark: SparkSession, sf: str) -> DataFrame:
    """Configured companies with one more, sorted and distinct."""
    return inc.add_to_config(tables.chunks(spark, sf).select("company_ticker"), spark.createDataFrame([("nflx",), ("SRC1",)], "company_ticker string"))


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that a file stream has stored, after two runs over the same input."""
    from quernstone.streaming.ingest import ingest
    from quernstone.workspace import new_path

    source, target, state = (new_path(spark, x) for x in ("arrived", "chunks", "state"))
    tables.chunks(spark, sf).select("company_ticker", "fiscal_year", "section_id", "text").write.parquet(source)
    for _ in range(2):
        ingest(spark, source, target, state)
    return spark.read.parquet(target).groupBy("company_ticker").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


#: What a tool may put before an answer: the first ends in a string with a brace, the second follows no rule of JSON.
PREFACES = ('{"tool": "quote", "note": "a } in \\"text\\""}\n', "{rate: {1, 2}} ")


def stream_holdback(spark: SparkSession, sf: str) -> DataFrame:
    """Answers from a stream of their tokens, without prefaces: two turns of three have one, and of these half are cut short."""
    from quernstone.streaming.holdback import released
    from quernstone.workspace import new_path

    source, target, state = (new_path(spark, x) for x in ("tokens", "answers", "state"))
    turn, text = F.col("turn"), F.coalesce("text", F.lit(""))
    said = F.when(turn % 3 == 1, text).when(turn % 3 == 0, F.concat(F.lit(PREFACES[0]), text)).otherwise(F.concat(F.lit(PREFACES[1]), F.substring(text, F.lit(1), (F.col("conv_id") % 40).cast("int"))))
    rows = tables.table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("answer"), said.alias("said")).filter("said <> ''")
    size = 5 + F.crc32(F.col("answer").cast("binary")) % 11
    # One scan of each text; pieces by position would search each from the text's begin.
    tokens = F.regexp_extract_all("said", F.format_string("(?s).{1,%d}", size), F.lit(0))
    rows = spread(rows).select("answer", tokens.alias("tokens"))
    rows.select("answer", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "token")).select("answer", F.col("at").cast("long").alias("seq"), "token", (F.col("at") == F.col("n") - 1).alias("last")).write.parquet(source)
    stream = released(spark.readStream.schema("answer string, seq long, token string, last boolean").parquet(source))
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    out = spark.read.schema("answer string, seq long, text string").parquet(target).groupBy("answer").agg(F.array_join(pieces, "").alias("text"))
    return out.select("answer", F.length("text").cast("long").alias("n_chars"), F.sha1(F.col("text").cast("binary")).alias("sha1"))


QUERIES = {f.__name__: f for f in (chunk_window, chunk_table_function, main_document, section_split, table_aware_chunk, html_clean, skippable_chunks, filing_year_prune, triplet_parse, json_repair, incremental_append, pending_chunks, purge_pair, missing_pairs, upsert_last_non_null, upsert_rows, progress_latest, ttl_filter, stale_locks, config_union, stream_ingest, stream_holdback)}
_WORDS = "list_filter(regexp_split_to_array({}, '[\\s   -     　\\x{{85}}\\x0b\\x1c-\\x1f]+'), lambda w: w <> '')"
_WINDOW = f"""WITH {CHUNKS}, t AS (SELECT *, {_WORDS.format("coalesce(text, '')")} AS toks FROM chunks),
    w AS (SELECT *, CASE WHEN len(toks) <= 600 THEN [0] ELSE range(0, len(toks), 510) END AS starts FROM t),
    p AS (SELECT chunk_id AS doc_id, company_ticker, fiscal_year, section_id, list_filter(list_transform(starts, lambda s: toks[s + 1 : s + 600]), lambda x: len(x) >= 50) AS pieces FROM w),
    u AS (SELECT *, unnest(pieces) AS piece, unnest(range(len(pieces))) AS chunk_seq FROM p),
    x AS (SELECT *, array_to_string(piece, ' ') AS body FROM u)"""
_ITEM = r"(?i)^\s*(?:#+\s*)?item (" + "|".join(sorted((x.split()[1] for x in SECTION_ITEMS), key=len, reverse=True)) + r")\b"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _raw_filings() -> str:
    lines = "chr(10) || coalesce(text, '')"
    for old, new in HEADED:
        lines = f"replace({lines}, {_quoted(old)}, {_quoted(new)})"
    kinds = " ".join(f"WHEN {i} THEN replace({_quoted(before)}, '{{text}}', coalesce(text, '')) || {lines} || {_quoted(after)}" for i, (before, after) in enumerate(WRAPPED))
    return f"f AS (SELECT chunk_id AS filing, company_ticker, fiscal_year, CASE chunk_id % {len(WRAPPED)} {kinds} END AS raw FROM chunks)"


_MAIN = rf"""WITH {CHUNKS}, {_raw_filings()},
    d AS (SELECT *, list_filter(regexp_split_to_array(raw, '(?i)<DOCUMENT>'), lambda x: regexp_matches(x, '(?i)<TEXT>')) AS docs FROM f),
    a AS (SELECT *, list_filter(docs, lambda x: regexp_matches(x, '(?im)<TYPE>\s*10-K(?:/[^\s<]*)?\s*(?:$|<|\n)'))[1:1] AS annual FROM d),
    b AS (SELECT *, flatten(list_transform(CASE WHEN len(annual) > 0 THEN annual ELSE docs END, lambda x: regexp_extract_all(x, '(?is)<TEXT>(.*?)(?:</TEXT>|\z)', 1))) AS bodies FROM a),
    m AS (SELECT filing, company_ticker, fiscal_year, CASE WHEN NOT regexp_matches(raw, '(?i)<TEXT>') THEN raw ELSE coalesce(regexp_replace(list_filter(bodies, lambda x: length(x) = list_max(list_transform(bodies, lambda y: length(y))))[1], '\A\s+|\s+\z', '', 'g'), raw) END AS text FROM b)"""
_SECTIONS = rf"""{_MAIN},
    l AS (SELECT * EXCLUDE (text), unnest(lines) AS line, unnest(range(len(lines))) AS place FROM (SELECT *, regexp_split_to_array(replace(text, chr(160), ' '), '\r\n|\r|\n') AS lines FROM m)),
    h AS (SELECT *, nullif(upper(regexp_extract(trim(line, ' '), '{_ITEM}', 1)), '') AS item FROM l WHERE trim(line, ' ') <> ''),
    r AS (SELECT *, count(item) OVER w AS section_no, last_value(item IGNORE NULLS) OVER w AS last_item FROM h WHERE item IS NOT NULL OR NOT regexp_matches(line, '(?i)^\s*(#+\s*)?item\s+\d+[a-z]?(\.\d+)?\s*\.?\s*\|') WINDOW w AS (PARTITION BY filing, company_ticker, fiscal_year ORDER BY place)),
    s AS (SELECT filing, company_ticker, fiscal_year, section_no, 'Item ' || last_item AS section_id, string_agg(line, chr(10) ORDER BY place) AS content FROM r WHERE item IS NULL AND section_no > 0 GROUP BY ALL)"""
#: What the outputs hold, by construction: SQL has no tolerant parser.
_SAID = """WITH c AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS chunk_id, c_name AS n, c_mktsegment AS s, '7' || lpad(c_custkey::VARCHAR, 12, '0') AS v, 'C' || c_custkey AS t, 2024 + c_custkey % 2 AS y FROM customer)"""
SQL = {
    "main_document": f"{_MAIN} SELECT filing, company_ticker, fiscal_year, length(text) AS n_chars, sha1(text) AS sha1 FROM m",
    "section_split": f"{_SECTIONS} SELECT filing, company_ticker, fiscal_year, section_no, section_id, length(content) AS n_chars, sha1(content) AS sha1 FROM s",
    "json_repair": f"""{_SAID}, p AS (SELECT chunk_id, 'operates_in' AS relation, n AS source, s AS target, NULL AS value, NULL AS unit, NULL AS year FROM c WHERE k % 8 IN (0, 2)
        UNION ALL SELECT chunk_id, 'competes_with', n, 'Rival ' || n, NULL, NULL, NULL FROM c WHERE k % 8 = 1 UNION ALL SELECT chunk_id, 'reported_metric', n, 'Net Income', v, NULL, '2023' FROM c WHERE k % 8 = 1
        UNION ALL SELECT chunk_id, 'impacts_revenue', n, 'Revenue', NULL, NULL, NULL FROM c WHERE k % 8 = 3 UNION ALL SELECT (k - 5)::VARCHAR, 'mitigates_risk', s, 'Rates', NULL, NULL, NULL FROM c WHERE k % 8 = 5
        UNION ALL SELECT chunk_id, 'competes_with', n, n, NULL, NULL, NULL FROM c WHERE k % 8 = 6 UNION ALL SELECT chunk_id, 'competes_with', n, 'Others', NULL, NULL, NULL FROM c WHERE k % 8 = 7
        UNION ALL SELECT chunk_id, 'competes_with', 'Facebook', 'Meta Platforms', NULL, NULL, NULL FROM c WHERE k % 8 = 7 UNION ALL SELECT chunk_id, 'reported_metric', n, 'EPS', v, 'USD', NULL FROM c WHERE k % 8 = 7)
        SELECT * FROM p""",
    "triplet_parse": f"""{_SAID} SELECT chunk_id, 'OPERATES_IN' AS rel, 'Company' AS src_label, n AS src, 'BusinessSegment' AS dst_label, s AS dst FROM c WHERE k % 8 IN (0, 2)
        UNION ALL SELECT chunk_id, 'COMPETES_WITH', 'Company', n, 'Company', 'Rival ' || n FROM c WHERE k % 8 = 1 UNION ALL SELECT chunk_id, 'REPORTED_METRIC', 'Company', n, 'FinancialMetric', t || '_2023_net_income' FROM c WHERE k % 8 = 1
        UNION ALL SELECT chunk_id, 'IMPACTS_REVENUE', 'MacroEvent', n, 'FinancialMetric', t || '_' || y || '_revenue' FROM c WHERE k % 8 = 3
        UNION ALL SELECT (k - 5)::VARCHAR, 'MITIGATES_RISK', 'BusinessSegment', s, 'RiskFactor', 'Rates' FROM c WHERE k % 8 = 5
        UNION ALL SELECT chunk_id, 'REPORTED_METRIC', 'Company', n, 'FinancialMetric', t || '_' || (2019 + k % 7) || '_eps' FROM c WHERE k % 8 = 7""",
    "stream_holdback": f"""WITH a AS (SELECT conv_id || '-' || turn AS answer, CASE turn % 3 WHEN 0 THEN '{PREFACES[0]}' WHEN 2 THEN '{PREFACES[1]}' ELSE '' END AS preface, CASE WHEN turn % 3 = 2 THEN left(coalesce(text, ''), conv_id % 40) ELSE coalesce(text, '') END AS body FROM conversations),
        b AS (SELECT answer, CASE WHEN preface = '' OR length(ltrim(body)) <= 20 THEN preface || body ELSE ltrim(body) END AS text FROM a)
        SELECT answer, length(text) AS n_chars, sha1(text) AS sha1 FROM b WHERE text <> ''""",
    "chunk_window": f"""{_WINDOW} SELECT doc_id, chunk_seq, len(piece) AS token_count, left(sha1(concat_ws('|', company_ticker, fiscal_year, section_id, 1, chunk_seq, body)), 32) AS chunk_id FROM x""",
    "chunk_table_function": f"{_WINDOW} SELECT doc_id, chunk_seq, len(piece) AS token_count, left(sha1(concat_ws('|', company_ticker, fiscal_year, section_id, 1, chunk_seq, body)), 32) AS chunk_id FROM x",
    "stream_ingest": f"{_WINDOW}, d AS (SELECT DISTINCT company_ticker, fiscal_year, section_id, chunk_seq, body, len(piece) AS n FROM x) SELECT company_ticker, count(*) AS n, sum(n)::BIGINT AS tokens FROM d GROUP BY company_ticker",
    "skippable_chunks": f"""WITH {CHUNKS}, s AS (SELECT *, CASE WHEN chunk_id % 3 = 0 THEN 'Signatures' ELSE section_id END AS section FROM chunks)
        SELECT chunk_id, section FROM s WHERE len({_WORDS.format("coalesce(text, '')")}) < 20 OR (regexp_matches(section, '(?i)(table of contents|exhibit\\s+\\d+|power of attorney|signatures?)') AND NOT (contains(lower(text), 'revenue') OR contains(lower(text), 'segment') OR contains(lower(text), 'risk') OR contains(lower(text), 'competitor') OR contains(lower(text), 'subsidiary') OR contains(lower(text), 'market')))""",
    "filing_year_prune": """WITH f AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'loose.txt' ELSE printf('/f/%010d-%02d-%06d/full.txt', o_custkey, o_orderkey % 4 + 22, o_orderkey) END AS path FROM orders)
        SELECT path, count(*) AS n FROM f WHERE path = 'loose.txt' OR regexp_extract(path, '\\d{10}-(\\d{2})-\\d{6}', 1) IN ('24', '') GROUP BY path""",
    "incremental_append": "SELECT doc_id AS chunk_id, source AS company_ticker FROM documents WHERE doc_id % 3 = 0",
    "pending_chunks": f"WITH {CHUNKS} SELECT company_ticker, fiscal_year, CASE WHEN chunk_id % 4 = 1 THEN 'cached' ELSE 'pending' END AS state, count(*) AS n FROM chunks GROUP BY ALL",
    "purge_pair": f"WITH {CHUNKS} SELECT company_ticker, fiscal_year, count(*) AS n FROM chunks WHERE NOT coalesce(company_ticker = 'src1' AND fiscal_year = 2025, false) GROUP BY ALL",
    "missing_pairs": f"""WITH {CHUNKS}, c AS (SELECT DISTINCT company_ticker FROM chunks WHERE company_ticker <> 'src3' UNION SELECT 'srcX'), w AS (SELECT company_ticker, fiscal_year FROM c, (VALUES (2024), (2025)) y(fiscal_year)),
        h AS (SELECT DISTINCT company_ticker, fiscal_year FROM chunks WHERE chunk_id % 5 <> 2 OR company_ticker <> 'src7')
        SELECT company_ticker, fiscal_year::BIGINT AS fiscal_year, 'missing' AS state FROM w WHERE (company_ticker, fiscal_year) NOT IN (SELECT (company_ticker, fiscal_year) FROM h) UNION ALL SELECT company_ticker, fiscal_year, 'orphan' FROM h WHERE (company_ticker, fiscal_year) NOT IN (SELECT (company_ticker, fiscal_year) FROM w)""",
    "upsert_last_non_null": "SELECT user_id, arg_max(event_type, event_id) FILTER (event_id % 3 <> 0 AND event_type IS NOT NULL) AS event_type, arg_max(round(value, 4), event_id) FILTER (event_id % 2 = 0 AND value IS NOT NULL) AS value FROM events GROUP BY user_id",
    "upsert_rows": "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(round(value, 4), event_id) AS value FROM events GROUP BY user_id",
    "progress_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "ttl_filter": "SELECT event_type, count(*) AS n FROM events WHERE floor(epoch(TIMESTAMP '2024-01-20 00:00:00')) - floor(epoch(ts)) < 259200 GROUP BY event_type",
    "stale_locks": "SELECT user_id, event_id FROM events WHERE event_type = 'signup' AND floor(epoch(TIMESTAMP '2024-01-15 12:00:00')) - floor(epoch(ts)) >= 21600",
    "config_union": "SELECT DISTINCT upper(source) AS company_ticker FROM documents UNION SELECT 'NFLX' UNION SELECT 'SRC1'",
}
