"""Scalar functions: fixed results."""

import pytest
from pyspark.sql import functions as F

from quernstone.functions import scalars as s
from quernstone.functions.tables import QUERY_ALIASES, TICKERS


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")


def run(spark, values, make, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(make(F.col("x"))).collect()]


def test_tokens(spark):
    assert run(spark, ["a b  c\n", "", "   "], s.tokens) == [["a", "b", "c"], [], []]
    assert run(spark, ["rev-2023 $1.2B!"], s.bm25_tokens) == [["rev", "2023", "1", "2b"]]
    assert run(spark, ["rev 2023 $1.2B rev"], s.word_set) == [["rev", "2023", "1", "2b"]]


def test_jaccard_and_sigmoid(spark):
    rows = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"]), ([], ["a"]), (["a"], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(s.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 1.0]
    assert run(spark, [0.0], s.sigmoid, "double") == [0.5]


@pytest.mark.parametrize("name,want", [("Total Net Sales", "total_net_sales"), ("  --R&D (%)-- ", "r_d"), ("!!!", "metric"), ("x" * 100, "x" * 80)])
def test_slug(spark, name, want):
    assert run(spark, [name], s.slug) == [want]


def test_companies(spark):
    names = ["Apple Inc.", "microsoft", "AM,ZN", "Amazon, Inc.", "NV. DA", "BRK, B", "metals exchange", "Acme GmbH", "  ", "brk.b"]
    assert run(spark, names, s.canonical_company) == ["AAPL", "MSFT", "AMZN", "AMZN", "NVDA", "BRK.B", "META", "Acme GmbH", None, "BRK.B"]
    assert run(spark, ["our competitors", "Third-party sellers", "x" * 61, "Acme", " "], s.noisy_company) == [True, True, True, False, True]
    assert run(spark, ["Providers of gas", "1)", "firms in various industries", "Azure"], s.noise_name) == [True, True, True, False]


def test_entity_keys(spark):
    rows = spark.createDataFrame([("Apple", "Company"), ("Others", "Company"), ("Net Sales", "FinancialMetric"), ("Apple", "BusinessSegment"), ("Cloud", "BusinessSegment"), ("z" * 301, "RiskFactor"), ("", "Company")], "n string, l string")
    got = [r[0] for r in rows.select(s.entity_key(F.col("n"), F.col("l"), F.lit("aapl"), F.lit(2024))).collect()]
    assert got == ["AAPL", None, "AAPL_2024_net_sales", None, "Cloud", None, None]


def test_years_and_tickers(spark):
    assert run(spark, ["2019 2018 2024 2024 x2025 2029. 2030", None], s.years) == [[2019, 2024, 2029], []]
    rows = spark.createDataFrame([("2024-12-31", 1), ("FY24", 2), ("2031", 3), (None, 4)], "r string, f long")
    assert [r[0] for r in rows.select(s.coerced_year(F.col("r"), F.col("f"))).collect()] == [2024, 2, 3, 4]
    got = run(spark, ["Apple and MSFT", "J&J or coca-cola", "metals", "BRK.B?"], lambda c: s.mentioned(c, QUERY_ALIASES, list(TICKERS)))
    assert got == [["AAPL", "MSFT"], ["JNJ", "KO"], [], ["BRK.B"]]


def test_questions(spark):
    assert run(spark, ["EPS of it", "nothing"], s.expanded_query) == ["EPS of it earnings per share diluted eps", "nothing"]
    got = run(spark, ["What is Apple's net income and AAPL revenue"], s.entity_candidates)[0]
    assert {"AAPL", "Apple", "net income and"} <= set(got) and "What" not in got and got == sorted(got)


@pytest.mark.parametrize("raw,want", [("$391,035", 391035.0), ("12.5B", 12.5e9), ("5%", 5.0), ("3 million", 3e6), ("about 7.5 units", 7.5), ("none", None), ("-2k", -2000.0)])
def test_numbers(spark, raw, want):
    assert run(spark, [raw], s.parsed_number) == [want]


def test_calculator(spark):
    rows = spark.createDataFrame([("yoy_pct", 110.0, 100.0), ("diff", 3.0, 5.0), ("ratio", 1.0, 4.0), ("ratio", 1.0, 0.0), ("pct_change", 1.0, -2.0), ("sum", 1.0, 2.0), ("avg", 1.0, 2.0), ("power", 1.0, 2.0)], "o string, a double, b double")
    assert [r[0] for r in rows.select(s.calculate(F.col("o"), F.col("a"), F.col("b"))).collect()] == [10.0, -2.0, 0.25, None, 150.0, 3.0, 1.5, None]


def test_market_caps(spark):
    assert run(spark, [3585000.0, 2500.0, 45.4, 0.0], s.market_cap, "double") == ["$3.58T", "$2.5B", "$45M", ""]
    assert run(spark, [0.45, -821.16, 0.0000123456789, -0.5, 0.999999, 0.9999999], s.market_cap, "double") == ["$450000", "$-8.2116e+08", "$12.3457", "$-500000", "$999999", "$1e+06"]


def test_model_text(spark):
    assert run(spark, ["<think>a\nb</think> ok", "```json\n{}\n```"], s.without_thinking) == ["ok", "{}"]
    rows = spark.createDataFrame([("few words", "Item 1"), ("word " * 30, "Signatures"), ("revenue " * 30, "Exhibit 21"), ("word " * 30, "Item 1")], "t string, n string")
    assert [r[0] for r in rows.select(s.skippable(F.col("t"), F.col("n"))).collect()] == [True, True, False, False]
