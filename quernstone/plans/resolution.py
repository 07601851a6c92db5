"""Queries that resolve free texts to companies; customers stand for the known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.functions.tables import RESOLUTION_FILLERS
from quernstone.operators import resolution
from quernstone.sources import tables


def _universe(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("name"))


def company_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Requests, one for each supplier, that name a company by its ticker, alone or among a few words."""
    key = F.col("s_suppkey")
    texts = F.when(key % 4 == 0, F.format_string("c%d.", key)).when(key % 4 == 1, F.format_string("Add C%d to the 2025 list", key)).when(key % 4 == 2, F.format_string("which of C%d and C%d", key, key + 1)).otherwise(F.format_string("C%d jones industrial average index", key))
    asked = tables.table(spark, sf, "supplier").select(key.alias("query_id"), texts.alias("text"))
    return resolution.resolve(asked, _universe(spark, sf)).filter("exact").select("query_id", "ticker", "name")


def company_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """The five customers whose names are most like a text, for one text of each nation."""
    n = F.col("n_nationkey")
    segment = F.element_at(F.array(*map(F.lit, ("automobil", "bulding", "furnitre", "househld", "machinry"))), (n % 5 + 1).cast("int"))
    texts = tables.table(spark, sf, "nation").select(n.cast("long").alias("query_id"), F.concat_ws(" ", F.lit("custommer"), F.lpad((n * 37).cast("string"), 9, "0"), segment).alias("text"))
    return resolution.closest(texts, _universe(spark, sf))


QUERIES = {f.__name__: f for f in (company_exact, company_resolution)}
#: The ratio of matching blocks has no SQL; a test holds it against brute force.
SQL = {
    "company_exact": rf"""WITH u AS (SELECT 'C' || c_custkey AS ticker, c_name || ' ' || c_mktsegment AS name FROM customer),
        t AS (SELECT s_suppkey AS k, lower(CASE k % 4 WHEN 0 THEN 'c' || k || '.' WHEN 1 THEN 'Add C' || k || ' to the 2025 list' WHEN 2 THEN 'which of C' || k || ' and C' || (k + 1) ELSE 'C' || k || ' jones industrial average index' END) AS text FROM supplier),
        m AS (SELECT DISTINCT k, text, ticker FROM (SELECT k, text, unnest(regexp_extract_all(text, '[a-z0-9.]{{1,10}}')) AS word FROM t) JOIN u ON upper(replace(word, '.', '')) = ticker),
        a AS (SELECT k, text, min(ticker) AS ticker FROM m GROUP BY k, text HAVING count(*) = 1),
        b AS (SELECT k, ticker FROM a WHERE len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text, '\b' || lower(ticker) || '\b', ' ', 'g'), '\b20(?:2[0-9]|19)\b', ' ', 'g'), '\b({'|'.join(RESOLUTION_FILLERS)})\b', ' ', 'g'), '\S+')) <= 2),
        e AS (SELECT k, ticker FROM t JOIN u ON upper(regexp_replace(text, '[\s.]', '', 'g')) = ticker UNION SELECT k, ticker FROM b)
        SELECT k AS query_id, ticker, name FROM e JOIN u USING (ticker)""",
}
