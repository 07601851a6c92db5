"""Queries over names, numbers, conversations, news and the quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quernstone.functions import scalars as s
from quernstone.functions.tables import BRK_FORMS, COMPACT_WORDS, COMPANY_ALIASES, NOISY_COMPANIES, NOISY_COMPANY_PREFIXES, QUERY_ALIASES, STOPWORDS, TICKERS
from quernstone.operators import dialogue as d, incremental as inc
from quernstone.sources import tables

#: Company names as models write them, with what they stand for.
COMPANY_NAMES = ("Apple Inc.", "microsoft", "AM,ZN", "Amazon, Inc.", "NV. DA", "BRK, B", "metals exchange", "Acme GmbH", "", "our competitors", "Third-party sellers", "brk.b")
#: Questions with tickers, years and phrases.
ASKED = ("How did Apple's net income change from 2023 to 2024?", "MSFT and google revenue 2025", "supply chain of the year 2018", "¿y en 2023?", "What is the gross margin of Berkshire Hathaway in 2019 and 2021", "Coca-Cola or J&J?", "")


def metric_slug_id(spark: SparkSession, sf: str) -> DataFrame:
    """Composite ids of part names."""
    part = tables.table(spark, sf, "part")
    return part.select("p_partkey", s.metric_id(F.col("p_brand"), F.lit(2024) + F.col("p_size") % 2, F.col("p_name")).alias("metric_id"))


def extract_years(spark: SparkSession, sf: str) -> DataFrame:
    """Years named in documents with a date written into them."""
    docs = tables.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("in "), (2015 + F.col("doc_id") % 20).cast("string"), F.lit(" and "), (2012 + F.col("doc_id") % 17).cast("string"), F.lit(". "), "text").alias("text"))
    return docs.select("doc_id", F.array_join(s.years(F.col("text")), ",").alias("years"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn of a user, begun with one of the questions."""
    turns = tables.table(spark, sf, "conversations").filter("role = 'user'")
    first = F.element_at(F.array(*map(F.lit, ASKED)), ((F.col("conv_id") + F.col("turn")) % len(ASKED) + 1).cast("int"))
    return turns.select("conv_id", "turn", F.concat(first, F.lit(" "), "text").alias("question"))


def extract_tickers(spark: SparkSession, sf: str) -> DataFrame:
    """Tickers and years that users' turns name."""
    found = s.mentioned(F.col("question"), QUERY_ALIASES, list(TICKERS))
    return _asked(spark, sf).select("conv_id", "turn", F.array_join(found, ",").alias("tickers"), F.array_join(s.years(F.col("question")), ",").alias("years"))


def entity_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """What users' turns may name."""
    return _asked(spark, sf).select("conv_id", "turn", F.array_join(s.entity_candidates(F.col("question")), "|").alias("candidates"))


def company_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical companies, and which are noise: a name for each order, as it is, in capitals, with blanks or with a number."""
    key = F.col("o_orderkey")
    name = F.element_at(F.array(*map(F.lit, COMPANY_NAMES)), (key % len(COMPANY_NAMES) + 1).cast("int"))
    form = F.floor(key / 16) % 4
    written = F.when(form == 1, F.upper(name)).when(form == 2, F.concat(F.lit("  "), name, F.lit(" "))).when(form == 3, F.concat(name, F.lit(" "), (key % 10).cast("string"))).otherwise(name)
    out = tables.table(spark, sf, "orders").select(key.alias("id"), s.canonical_company(written).alias("company"))
    return out.select("id", "company", F.coalesce(s.noisy_company(F.col("company")), F.lit(True)).alias("dropped"))


def year_coerce(spark: SparkSession, sf: str) -> DataFrame:
    """Years from what a model wrote, else the filing's."""
    rows = tables.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "n/a").when(F.col("o_orderkey") % 5 == 1, "FY24").otherwise(F.concat((2010 + F.col("o_orderkey") % 30).cast("string"), F.lit("-12-31"))).alias("raw"))
    return rows.select("o_orderkey", s.coerced_year(F.col("raw"), F.lit(2024).cast("bigint")).alias("year"))


def calculator(spark: SparkSession, sf: str) -> DataFrame:
    """All operations on written prices."""
    rows = tables.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("a"), F.when(F.col("o_orderkey") % 50 == 0, "0").otherwise(F.concat((F.col("o_orderkey") % 90 + 10).cast("string"), F.lit(".5K"))).alias("b"))
    a, b = s.parsed_number(F.col("a")), s.parsed_number(F.col("b"))
    return rows.select("o_orderkey", *(F.round(s.calculate(F.lit(op), a, b), 4).alias(op) for op in ("yoy_pct", "diff", "ratio", "sum", "avg")))


def market_caps(spark: SparkSession, sf: str) -> DataFrame:
    """Balances as market capitalisations, some of them missing, none, or below a million."""
    key = F.col("s_suppkey")
    balance = F.floor(F.col("s_acctbal")) * F.when(key % 2 == 0, 1000).otherwise(1)
    value = F.when(key % 11 == 0, None).when(key % 11 == 1, 0).when(key % 11 == 2, (key % 1000 + 1) / 1024).otherwise(balance)
    return tables.table(spark, sf, "supplier").select("s_suppkey", s.market_cap(value.cast("double")).alias("cap"))


def conversation_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Title and turns of each conversation."""
    return d.summaries(tables.table(spark, sf, "conversations"))


def conversation_trim(spark: SparkSession, sf: str) -> DataFrame:
    """The last 100 messages of each conversation, 4000 characters each."""
    return d.trim(tables.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))


def history_block(spark: SparkSession, sf: str) -> DataFrame:
    """The last messages of each conversation as lines."""
    return d.history(tables.table(spark, sf, "conversations"))


def conversation_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Messages by conversation without two of them."""
    return d.without(tables.table(spark, sf, "conversations"), [0, 3]).groupBy("conv_id").agg(F.count("*").alias("n"))


def _spoken(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with a request put before their text."""
    said = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("añade MSFT "), (2020 + F.col("turn") % 9).cast("string"), F.lit(": "))).when(F.col("conv_id") % 4 == 1, F.lit("no añadas AAPL 2024, ")).when((F.col("conv_id") % 4 == 2) & (F.col("turn") == 0), F.lit("tell me of TSLA in 2023 ")).otherwise(F.lit("and then "))
    rows = tables.table(spark, sf, "conversations").filter("role = 'user'").withColumn("said", F.concat(said, F.col("text")))
    return rows.withColumn("ticker", F.element_at(F.array_append(s.mentioned(F.col("said"), {}, list(TICKERS)), F.lit(None)), 1)).withColumn("year", F.element_at(F.array_append(s.years(F.col("said")), F.lit(None).cast("bigint")), 1))


def intent_rules(spark: SparkSession, sf: str) -> DataFrame:
    """What each user turn asks for."""
    return _spoken(spark, sf).select("conv_id", "turn", d.intent(F.col("said"), F.col("ticker"), F.col("year")).alias("intent"), "ticker", "year")


def followup_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Ticker and year of each user turn, from the turns before where it names none."""
    return d.follow_up(_spoken(spark, sf).select("conv_id", "turn", "ticker", "year"))


def orphan_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks without a purchase of the same user an event later, as open calls."""
    events = tables.table(spark, sf, "events")
    calls = events.filter("event_type = 'click'").select(F.concat_ws("-", "user_id", F.col("event_id") % 50).alias("call_id"), "event_id")
    results = events.filter("event_type = 'purchase'").select(F.concat_ws("-", "user_id", F.col("event_id") % 50).alias("call_id"))
    return d.open_calls(calls, results)


def news_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """The six most relevant documents as news of one company."""
    items = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 97 == 0, F.lit("X, brk.b")).otherwise(F.col("source")).alias("related"), F.col("source").alias("headline"), F.col("text").alias("summary"), (F.col("doc_id") * 7919 % 1000).alias("at"))
    return d.news(items, "BRKB", ["onesen", "therhe"]).select("item_id", "relevance", "at")


def suggestion_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The first five unindexed companies of several lists."""
    n = tables.table(spark, sf, "nation").select(F.col("n_name").alias("company_ticker"), F.col("n_nationkey").alias("pos"), "n_regionkey")
    lists = {"peers": n.filter("n_regionkey = 1"), "competitors": n.filter("n_nationkey % 3 = 0"), "context": n.filter("n_nationkey >= 20")}
    return inc.merge_suggestions(lists, n.filter("n_nationkey % 5 = 0"), n.filter("n_nationkey <> 2"))


def fuzzy_company(spark: SparkSession, sf: str) -> DataFrame:
    """Nations with a name like a misspelt one."""
    return inc.fuzzy(tables.table(spark, sf, "nation").select(F.col("n_name").alias("name")), "NATIN_12")


_CHECKS = ["has_label", "is_good", "is_clean", "is_long"]


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.table(spark, sf, "documents").select("doc_id", "n_chars").join(tables.table(spark, sf, "labels"), "doc_id", "left")
    return d.checks(docs.select("doc_id", F.col("quality").isNotNull().alias("has_label"), (F.col("quality") == 1).alias("is_good"), (F.col("toxic") == 0).alias("is_clean"), (F.col("n_chars") > 500).alias("is_long")), _CHECKS)


def eval_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The quality gate over boolean checks of all documents."""
    return d.gate(_checked(spark, sf), _CHECKS)


def message_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Turns whose predecessor is missing or of the same role, where one in five has been lost and one in seven is a system's."""
    run = Window.partitionBy("conv_id").orderBy("turn")
    rows = tables.table(spark, sf, "conversations").filter((F.col("conv_id") * 3 + F.col("turn")) % 5 != 4)
    rows = rows.withColumn("role", F.when((F.col("conv_id") + F.col("turn")) % 7 < 2, "system").otherwise(F.col("role")))
    rows = rows.withColumn("before", F.lag("turn").over(run)).withColumn("said", F.lag("role").over(run))
    return rows.filter((F.col("before") != F.col("turn") - 1) | (F.col("said") == F.col("role"))).select("conv_id", "turn")


def conversation_list(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations, the newest first; each message's time follows from its numbers."""
    at = F.col("conv_id") * 7919 % 1000 * 100 + F.col("turn")
    return d.listing(tables.table(spark, sf, "conversations").withColumn("at", at))


def news_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The days of events from their Unix times, and which lie in the last days before the end of January."""
    rows = tables.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, 0).when(F.col("event_id") % 50 != 1, F.unix_timestamp("ts")).alias("at"))
    rows = rows.withColumn("day", s.epoch_date(F.col("at")))
    days = F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("event_id") % 40 - 2).cast("int")
    inside = s.within_days(F.when(F.col("day") != "", F.col("day")).cast("date"), F.lit("2024-01-31").cast("date"), days)
    return rows.select("event_id", "day", F.coalesce(inside, F.lit(False)).alias("recent"))


def metadata_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Records of documents with the metadata of their labels put over them."""
    docs, labels = tables.table(spark, sf, "documents"), tables.table(spark, sf, "labels")
    text = lambda c: F.col(c).cast("string")
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = docs.join(marks, "doc_id", "left").select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("quality"), F.lit("none")).alias("record"), F.when(F.col("toxic").isNotNull(), F.create_map(F.lit("quality"), text("quality"), F.lit("toxic"), text("toxic"))).alias("extra"))
    kept = s.merged(F.col("record"), F.col("extra"))
    return rows.select("doc_id", *(F.try_element_at(kept, F.lit(k)).alias(k) for k in ("lang", "source", "quality", "toxic")))


def conversation_append(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations after one more turn of every fifth, and a new one."""
    old = tables.table(spark, sf, "conversations")
    more = old.filter("turn = 0 AND conv_id % 5 = 0").select("conv_id", F.lit(1).alias("seq"), F.lit("q?").alias("question"), F.lit("a.").alias("answer"))
    more = more.unionByName(spark.createDataFrame([(10**9, 1, "first", "one"), (10**9, 2, "second", "two")], "conv_id long, seq int, question string, answer string"))
    return d.append_turns(old, more).select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n_chars"))


def metric_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Which user messages ask about metrics, where some have a keyword put before their text."""
    said = F.concat(F.when(F.col("turn") % 3 == 0, "Total Assets of ").when(F.col("conv_id") % 3 == 0, "EPS? ").otherwise(""), F.col("text"))
    return tables.table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", s.asks_metrics(said).alias("asks"))


def metric_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of one year whose name a hint names."""
    rows = tables.metrics(spark, sf).filter("fiscal_year = 1996").withColumn("metric", F.concat("name", F.lit(" of "), "ticker"))
    return rows.filter(s.hinted(F.col("metric"), F.lit("sales REVENUE"))).select("metric_id", "fiscal_year")


def valid_tickers(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' names as tickers: which are valid, and their keys."""
    rows = tables.table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("b."), F.col("s_suppkey").cast("string"))).otherwise(F.col("s_name")).alias("t"))
    return rows.select("s_suppkey", s.valid_ticker(F.col("t")).alias("valid"), s.ticker_key(F.col("t")).alias("key"))


def sample_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The boolean checks of samples, one for each order, against their lines as citations."""
    orders, line = tables.table(spark, sf, "orders"), tables.table(spark, sf, "lineitem")
    samples = orders.select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("T"), F.col("o_orderkey") % 4).alias("expected_ticker"), (1992 + F.col("o_orderkey") % 7).alias("expected_year"), F.lit("O").alias("expected_section"))
    results = orders.select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise(" ").alias("answer"), (F.col("o_orderkey") % 3).alias("dense"), F.lit(1).alias("sparse"), F.lit(0).alias("graph"))
    cited = line.select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("t"), F.col("l_linenumber")).alias("company_ticker"), F.year("l_shipdate").alias("fiscal_year"), F.lower("l_linestatus").alias("section_id"))
    return d.sample_checks(samples, results, cited)


QUERIES = {f.__name__: f for f in (metric_slug_id, extract_years, extract_tickers, entity_candidates, company_canonical, year_coerce, calculator, market_caps, conversation_summary, conversation_trim, history_block, conversation_delete, intent_rules, followup_resolve, orphan_calls, news_relevance, suggestion_merge, fuzzy_company, eval_gate, message_gaps, conversation_list, news_dates, metadata_merge, conversation_append, metric_gate, metric_lookup, valid_tickers, sample_checks)}
_SPOKEN = """sp AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'añade MSFT ' || (2020 + turn % 9) || ': ' WHEN conv_id % 4 = 1 THEN 'no añadas AAPL 2024, ' WHEN conv_id % 4 = 2 AND turn = 0 THEN 'tell me of TSLA in 2023 ' ELSE 'and then ' END || text AS said FROM conversations WHERE role = 'user'),
tk AS (SELECT *, list_sort(list_distinct(regexp_extract_all(upper(said), '\\b(?:AAPL|MSFT|AMZN|GOOGL|META|TSLA|NVDA|BRK\\.B)\\b')))[1] AS ticker, list_min(list_transform(regexp_extract_all(said, '\\b20(?:2[0-9]|19)\\b'), lambda y: y::BIGINT)) AS year FROM sp)"""


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_text, xs)) + "]"


def _case(of: str, pairs: dict[str, str]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {_text(a)} THEN {_text(b)}" for a, b in pairs.items()) + " END"


_ASKED = f"aq AS (SELECT conv_id, turn, {_list(ASKED)}[(conv_id + turn) % {len(ASKED)} + 1] || ' ' || text AS question FROM conversations WHERE role = 'user')"
_NAMED = ", ".join(f"CASE WHEN regexp_matches(lower(question), {_text(chr(92) + 'b' + s.quoted(a.lower()) + chr(92) + 'b')}) THEN {_text(b)} END" for a, b in (*QUERY_ALIASES.items(), *((x, x) for x in TICKERS)))
#: Letters that are no word characters to DuckDB's patterns; marks around them keep its word boundaries where they belong.
_MARKED = "([ªµºÀ-ÖØ-öø-ʯ])"
_LETTERS = " ".join(f"WHEN contains(letters, {_text(''.join(c for c in a if 'a' <= c <= 'z'))}) THEN {_text(b)}" for a, b in COMPANY_ALIASES.items())
SQL = {
    "metric_slug_id": "SELECT p_partkey, upper(p_brand) || '_' || (2024 + p_size % 2) || '_' || CASE WHEN trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'metric' ELSE left(trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_'), 80) END AS metric_id FROM part",
    "extract_years": "WITH d AS (SELECT doc_id, 'in ' || (2015 + doc_id % 20) || ' and ' || (2012 + doc_id % 17) || '. ' || text AS text FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\b(20(?:2[0-9]|19))\\b'), lambda y: y::BIGINT))), ',') AS years FROM d",
    "year_coerce": "WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' WHEN o_orderkey % 5 = 1 THEN 'FY24' ELSE (2010 + o_orderkey % 30) || '-12-31' END AS raw FROM orders) SELECT o_orderkey, CASE WHEN try_cast(left(raw, 4) AS BIGINT) BETWEEN 2015 AND 2030 THEN try_cast(left(raw, 4) AS BIGINT) ELSE 2024 END AS year FROM r",
    "calculator": """WITH r AS (SELECT o_orderkey, round(o_totalprice, 2) AS a, CASE WHEN o_orderkey % 50 = 0 THEN 0.0::DOUBLE ELSE (o_orderkey % 90 + 10 + 0.5::DOUBLE) * 1000 END AS b FROM orders)
        SELECT o_orderkey, round((a - nullif(b, 0)) / abs(nullif(b, 0)) * 100, 4) AS yoy_pct, round(a - b, 4) AS diff, round(a / nullif(b, 0), 4) AS ratio, round(a + b, 4) AS sum, round((a + b) / 2, 4) AS avg FROM r""",
    "market_caps": """WITH v AS (SELECT s_suppkey, CASE s_suppkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN (s_suppkey % 1000 + 1) / 1024::DOUBLE ELSE floor(s_acctbal) * CASE WHEN s_suppkey % 2 = 0 THEN 1000 ELSE 1 END END * 1e6 AS v FROM supplier)
        SELECT s_suppkey, CASE WHEN v >= 1e12 THEN printf('$%.2fT', v / 1e12) WHEN v >= 1e9 THEN printf('$%.1fB', v / 1e9) WHEN v >= 1e6 THEN printf('$%.0fM', v / 1e6) WHEN v <> 0 THEN printf('$%g', v) ELSE '' END AS cap FROM v""",
    "conversation_summary": "SELECT conv_id, arg_min(substr(text, 1, 60), turn) FILTER (role = 'user') AS title, count(*) // 2 AS turns, count(*) AS n_messages FROM conversations GROUP BY conv_id",
    "conversation_trim": "SELECT conv_id, turn, role, substr(text, 1, 4000) AS text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 100",
    "history_block": "WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Prev Q: ' ELSE 'Prev A: ' END || substr(text, 1, 500) AS line FROM conversations WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8) SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM m GROUP BY conv_id",
    "conversation_delete": "SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id NOT IN (0, 3) GROUP BY conv_id",
    "intent_rules": f"WITH {_SPOKEN} SELECT conv_id, turn, CASE WHEN (contains(lower(said), 'añade') OR contains(lower(said), 'añadir') OR contains(lower(said), 'ingest') OR contains(lower(said), 'agrega') OR contains(lower(said), 'add ')) AND NOT (contains(lower(said), 'no añadas') OR contains(lower(said), 'no quiero que añadas') OR contains(lower(said), 'no agregues')) AND ticker IS NOT NULL AND year IS NOT NULL THEN 'ingest' ELSE 'retrieve' END AS intent, ticker, year FROM tk",
    "followup_resolve": f"WITH {_SPOKEN}, l AS (SELECT conv_id, turn, ticker, year, last_value(CASE WHEN ticker IS NOT NULL THEN {{'t': ticker, 'y': year}} END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM tk) SELECT conv_id, turn, coalesce(ticker, b.t) AS ticker, coalesce(year, b.y) AS year FROM l",
    "orphan_calls": "SELECT user_id || '-' || (event_id % 50) AS call_id, event_id, '(interrupted)' AS content FROM events WHERE event_type = 'click' AND user_id || '-' || (event_id % 50) NOT IN (SELECT user_id || '-' || (event_id % 50) FROM events WHERE event_type = 'purchase')",
    "news_relevance": "WITH i AS (SELECT doc_id AS item_id, CASE WHEN doc_id % 97 = 0 THEN 3 WHEN contains(upper(coalesce(source, '') || ' ' || coalesce(text, '')), 'ONESEN') OR contains(upper(coalesce(source, '') || ' ' || coalesce(text, '')), 'THERHE') THEN 1 ELSE 0 END AS relevance, doc_id * 7919 % 1000 AS \"at\" FROM documents) SELECT item_id, relevance::BIGINT AS relevance, \"at\" FROM i WHERE relevance > 0 ORDER BY relevance DESC, \"at\" DESC, item_id LIMIT 6",
    "suggestion_merge": """WITH a AS (SELECT n_name AS company_ticker, 'peers' AS origin, 0 AS place, n_nationkey AS pos FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_name, 'competitors', 1, n_nationkey FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_name, 'context', 2, n_nationkey FROM nation WHERE n_nationkey >= 20),
        f AS (SELECT * FROM a WHERE company_ticker IN (SELECT n_name FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey <> 2) QUALIFY row_number() OVER (PARTITION BY company_ticker ORDER BY place, pos) = 1)
        SELECT company_ticker, origin, row_number() OVER (ORDER BY place, pos, company_ticker) AS rank FROM f QUALIFY rank <= 5""",
    "fuzzy_company": "SELECT n_name AS name, round(1 - levenshtein(lower(n_name), 'natin_12')::DOUBLE / greatest(length(n_name), 8), 6) AS score FROM nation WHERE round(1 - levenshtein(lower(n_name), 'natin_12')::DOUBLE / greatest(length(n_name), 8), 6) >= 0.5 ORDER BY score DESC, name LIMIT 5",
    "eval_gate": """WITH c AS (SELECT quality IS NOT NULL AS a, coalesce(quality = 1, false) AS b, coalesce(toxic = 0, false) AS c, coalesce(n_chars > 500, false) AS d FROM documents LEFT JOIN labels USING (doc_id)), s AS (SELECT *, (a::INT + b::INT + c::INT + d::INT) / 4.0::DOUBLE AS score FROM c)
        SELECT count(*) AS samples, round(avg(score), 6) AS mean_score, sum(a::INT)::BIGINT AS has_label, sum(b::INT)::BIGINT AS is_good, sum(c::INT)::BIGINT AS is_clean, sum(d::INT)::BIGINT AS is_long, round(avg(score), 6) >= 0.85 AS passed FROM s""",
    "message_gaps": "WITH m AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 < 2 THEN 'system' ELSE role END AS role FROM conversations WHERE (conv_id * 3 + turn) % 5 <> 4) SELECT conv_id, turn FROM m QUALIFY lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) <> turn - 1 OR lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role",
    "conversation_list": "SELECT conv_id, arg_min(substr(text, 1, 60), turn) FILTER (role = 'user') AS title, count(*) // 2 AS turns, count(*) AS n_messages, max(conv_id * 7919 % 1000 * 100 + turn) AS updated_at FROM conversations GROUP BY conv_id ORDER BY updated_at DESC, conv_id",
    "news_dates": """WITH e AS (SELECT event_id, CASE WHEN event_id % 50 IN (0, 1) THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS day, CASE WHEN event_id % 3 = 0 OR event_id % 40 = 2 THEN 7 ELSE greatest(1, least(event_id % 40 - 2, 30)) END AS days FROM events)
        SELECT event_id, day, coalesce(try_cast(day AS DATE) BETWEEN DATE '2024-01-31' - days::INTEGER AND DATE '2024-01-31', false) AS recent FROM e""",
    "metadata_merge": "WITH m AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) SELECT doc_id, lang, source, CASE WHEN toxic IS NULL THEN 'none' ELSE quality::VARCHAR END AS quality, toxic::VARCHAR AS toxic FROM documents LEFT JOIN m USING (doc_id)",
    "conversation_append": """WITH m AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, (SELECT max(turn) FROM conversations x WHERE x.conv_id = c.conv_id) + k, r, t FROM (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0 AND conv_id % 5 = 0) c, (VALUES (1, 'user', 'q?'), (2, 'assistant', 'a.')) v(k, r, t)
        UNION ALL SELECT * FROM (VALUES (1000000000, 0, 'user', 'first'), (1000000000, 1, 'assistant', 'one'), (1000000000, 2, 'user', 'second'), (1000000000, 3, 'assistant', 'two')) n(a, b, c, d))
        SELECT conv_id, turn, role, length(substr(text, 1, 4000)) AS n_chars FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 100""",
    "metric_gate": "WITH u AS (SELECT conv_id, turn, lower(CASE WHEN turn % 3 = 0 THEN 'Total Assets of ' WHEN conv_id % 3 = 0 THEN 'EPS? ' ELSE '' END || text) AS t FROM conversations WHERE role = 'user') SELECT conv_id, turn, regexp_matches(t, 'revenue|sales|net income|net earnings|eps|operating income|gross margin|total assets|cash|debt|liabilities|equity') AS asks FROM u",
    "metric_lookup": "SELECT DISTINCT upper(s_name) || '_1996_revenue' AS metric_id, 1996::BIGINT AS fiscal_year FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE year(l_shipdate) = 1996",
    "valid_tickers": "WITH t AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'b.' || s_suppkey ELSE s_name END AS t FROM supplier) SELECT s_suppkey, regexp_full_match(regexp_replace(t, '[.-]', '', 'g'), '[A-Za-z0-9]+') AS valid, regexp_replace(upper(t), '[.\\s]', '', 'g') AS key FROM t",
    "sample_checks": """WITH c AS (SELECT l_orderkey, list(DISTINCT 't' || l_linenumber) AS t, list(DISTINCT year(l_shipdate)) AS y, list(DISTINCT lower(l_linestatus)) AS s, count(*) AS n FROM lineitem GROUP BY l_orderkey)
        SELECT o_orderkey AS query_id, o_orderkey % 2 = 0 AS has_answer, coalesce(n > 0, false) AS has_citations, coalesce(list_contains(t, 't' || (o_orderkey % 4)), false) AS ticker_hit, coalesce(list_contains(y, 1992 + o_orderkey % 7), false) AS year_hit, coalesce(list_contains(s, 'o'), false) AS section_hit, o_orderkey % 3 > 0 AS dense_hit, true AS sparse_hit, false AS graph_hit FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""",
    "extract_tickers": f"""WITH {_ASKED} SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter([{_NAMED}], lambda x: x IS NOT NULL))), ',') AS tickers,
        array_to_string(list_sort(list_distinct(regexp_extract_all(question, '\\b(20(?:2[0-9]|19))\\b'))), ',') AS years FROM aq""",
    "entity_candidates": f"""WITH {_ASKED}, am AS (SELECT conv_id, turn, question, regexp_replace(question, '{_MARKED}', '_\\1_', 'g') AS marked FROM aq),
        f AS (SELECT *, list_filter(regexp_extract_all(marked, '\\b[A-Z][a-z]+(?:[ ''-][A-Z][a-z]+)*\\b'), lambda w: NOT list_contains({_list(STOPWORDS)}, lower(w))) AS proper,
          list_filter(regexp_extract_all(marked, '\\b[a-z][a-z]+(?:\\s[a-z][a-z]+)*\\b'), lambda w: NOT list_contains({_list(STOPWORDS)}, w)) AS plain,
          list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(regexp_replace(marked, '[\\s''-]+', ' ', 'g')), '\\b(?:{'|'.join(COMPACT_WORDS)})\\b', ' ', 'g'), '_{_MARKED}_', '\\1', 'g'), '\\s+'), lambda w: w <> '' AND NOT list_contains({_list(STOPWORDS)}, w)) AS left_over FROM am),
        c AS (SELECT conv_id, turn, list_transform(list_concat(list_concat(regexp_extract_all(marked, '\\b[A-Z]{{2,8}}\\b'), list_concat(proper, plain)),
          list_concat(list_filter(list_transform(list_concat(proper, plain), lambda w: {_case("lower(w)", QUERY_ALIASES)}), lambda x: x IS NOT NULL),
          CASE WHEN len(left_over) >= 2 THEN [array_to_string(left_over, ' ')] ELSE [] END)), lambda w: trim(w)) AS words FROM f)
        SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(words, lambda w: length(w) >= 2))), '|') AS candidates FROM c""",
    "company_canonical": f"""WITH w AS (SELECT o_orderkey AS id, {_list(COMPANY_NAMES)}[o_orderkey % {len(COMPANY_NAMES)} + 1] AS name, o_orderkey // 16 % 4 AS form FROM orders),
        n AS (SELECT id, trim(CASE form WHEN 1 THEN upper(name) WHEN 2 THEN '  ' || name || ' ' WHEN 3 THEN name || ' ' || (id % 10) ELSE name END) AS name FROM w),
        l AS (SELECT *, regexp_replace(lower(name), '[^a-z]', '', 'g') AS letters, regexp_replace(upper(name), '[^A-Z]', '', 'g') AS capitals FROM n),
        c AS (SELECT id, CASE WHEN name <> '' THEN coalesce({_case("lower(name)", COMPANY_ALIASES)}, CASE WHEN list_contains({_list(TICKERS)}, upper(name)) THEN upper(name) END, CASE {_LETTERS} END,
          CASE WHEN capitals <> 'BRK.B' AND list_contains({_list(TICKERS)}, capitals) THEN capitals WHEN list_contains({_list(BRK_FORMS)}, capitals) THEN 'BRK.B' END, name) END AS company FROM l)
        SELECT id, company, coalesce(trim(company) = '' OR list_contains({_list(NOISY_COMPANIES)}, lower(trim(company))) OR len(list_filter({_list(NOISY_COMPANY_PREFIXES)}, lambda p: starts_with(lower(trim(company)), p))) > 0 OR length(trim(company)) > 60, true) AS dropped FROM c""",
}
