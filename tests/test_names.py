"""The index of names against a scan of all names."""

import random

import pytest

from quernstone.operators import graph, names


def some_names(n=160):
    r = random.Random(3)
    words = ["net", "Income", "sales", "Growth", "de", "ÉTÉ", "oil", "a", "x1", "per-share", "…"]
    return [(r.choice(["RiskFactor", "FinancialMetric"]), f"k{i:03d}", " ".join(r.choices(words, k=r.randint(0, 5)))) for i in range(n)] + [("RiskFactor", "none", None), ("RiskFactor", "twice", "Income de"), ("RiskFactor", "twice", "Income de")]


TEXTS = ["income", "net income", "e", "de", "s ", "été", "per-share a", "…", "no such", "x1", "incomes", "come de", ""]


@pytest.mark.parametrize("stored", [True, False])
def test_names_that_contain_a_text(spark, stored):
    data = some_names()
    nodes = spark.createDataFrame(data, "label string, key string, name string")
    texts = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "low string")
    index = names.build_names(nodes, only=None if stored else names.starts(texts))
    got = sorted(tuple(r) for r in names.containing(index, texts).collect())
    assert got == sorted({(t, *d) for t in TEXTS for d in data if t and d[2] is not None and t in d[2].lower()})
    if not stored:
        assert index.postings.count() < names.build_names(nodes).postings.count()


def test_probes_are_the_rarest_trigrams(spark):
    nodes = spark.createDataFrame([("RiskFactor", str(i), "common words") for i in range(20)] + [("RiskFactor", "r", "common zebra")], "label string, key string, name string")
    index = names.build_names(nodes)
    texts = spark.createDataFrame([("common zebra",)], "low string")
    assert {r["gram"] for r in names._probes(index, texts).collect()} <= {" ze", "zeb", "ebr", "bra", "n z"}


def test_metrics_are_found_by_name_without_a_nested_loop(spark):
    nodes = spark.createDataFrame([("FinancialMetric", "AAPL_2024_net_income", "Net Income"), ("FinancialMetric", "AAPL_2023_net_income", "Net Income"), ("Company", "AAPL", "Apple Inc.")], "label string, key string, name string")
    asked = spark.createDataFrame([(1, "net income"), (1, "apple"), (2, "inc"), (2, "income")], "query_id long, candidate string")
    found = graph.find_entities(nodes, asked, {"apple": "AAPL"})
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, "apple", "Company", "AAPL"),
        (1, "net income", "FinancialMetric", "AAPL_2023_net_income"),
        (2, "inc", "Company", "AAPL"),
        (2, "inc", "FinancialMetric", "AAPL_2023_net_income"),
        (2, "income", "FinancialMetric", "AAPL_2023_net_income"),
    ]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
