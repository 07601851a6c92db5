"""Operators on small fixtures."""

import json
import math

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from quernstone.operators import chunking, dialogue, extraction, graph, incremental, retrieval as r


def test_rrf_of_one_id_first_in_three_lists(spark):
    hits = spark.createDataFrame([(1, s, "c1", 1) for s in ("dense", "sparse", "graph")] + [(1, "dense", "c2", 2)], "query_id long, source string, chunk_id string, rank long")
    got = {x["chunk_id"]: x for x in r.rrf(hits).collect()}
    assert got["c1"]["rrf_score"] == pytest.approx(3 / 61) and got["c1"]["rank"] == 1 and got["c2"]["rrf_score"] == pytest.approx(1 / 62)
    assert r.rrf(hits, k=1).count() == 1


def test_grounding_and_first_of_section(spark):
    rows = spark.createDataFrame([(1, "a", "AAPL", "Item 1", 1), (1, "b", "MSFT", "Item 1", 2), (1, "c", "AAPL", "Item 1", 3), (2, "d", "MSFT", "Item 7", 1)], "query_id long, chunk_id string, company_ticker string, section_id string, rank long")
    named = spark.createDataFrame([(1, ["AAPL"]), (2, [])], "query_id long, tickers array<string>")
    grounded = r.ground(rows, named)
    assert sorted(x["chunk_id"] for x in grounded.collect()) == ["a", "c", "d"]
    assert sorted(x["chunk_id"] for x in r.keep_first(grounded).collect()) == ["a", "d"]


def candidates(spark, texts):
    return spark.createDataFrame([(1, "q", i, t, i) for i, t in enumerate(texts)], "query_id long, question string, chunk_id long, text string, rank long")


def logits(spark, values):
    return lambda q, t: F.element_at(F.array(*map(F.lit, values)), F.col("chunk_id").cast("int") + 1)


def test_rerank_threshold_and_order(spark):
    got = r.rerank(candidates(spark, ["a", "b", "c", "d"]), k=2, min_score=0.2, scorer=logits(spark, [2.0, 0.5, -2.5, 0.3])).orderBy("position").collect()
    assert [x["chunk_id"] for x in got] == [0, 1]
    assert r.rerank(candidates(spark, ["a", "b", "c", "d"]), k=9, min_score=0.2, scorer=logits(spark, [2.0, 0.5, -2.5, 0.3])).count() == 3


def test_rerank_prefers_what_differs(spark):
    got = r.rerank(candidates(spark, ["net sales rose", "net sales rose", "cloud margin fell"]), k=2, weight=0.5, scorer=logits(spark, [1.0, 1.0, 1.0])).orderBy("position").collect()
    assert [x["chunk_id"] for x in got] == [0, 2]


def test_contexts_and_citations(spark):
    ranked = spark.createDataFrame([(1, 1, "c1", 0.9, "AAPL", 2024, "Item 7", "x"), (1, 2, "c2", 0.8, "AAPL", 2024, "Item 8", "y")], "query_id long, position long, chunk_id string, score double, company_ticker string, fiscal_year long, section_id string, text string")
    assert r.contexts(ranked).head()["context"] == "[1] (AAPL 2024, Item 7)\nx\n---\n[2] (AAPL 2024, Item 8)\ny"
    more = spark.createDataFrame([(1, "c2"), (1, "c3"), (1, "c3")], "query_id long, chunk_id string")
    assert [(x["chunk_id"], x["source"]) for x in r.citations(ranked, more).orderBy("chunk_id").collect()] == [("c1", "context"), ("c2", "context"), ("c3", "metrics")]


@pytest.mark.parametrize("n,sizes", [(0, []), (49, []), (50, [50]), (600, [600]), (601, [600, 91]), (1020, [600, 510]), (1059, [600, 549]), (1100, [600, 590, 80])])
def test_windows(spark, n, sizes):
    rows = spark.createDataFrame([("A", 2024, "Item 1", " ".join(map(str, range(n))))], "company_ticker string, fiscal_year long, section_id string, text string")
    got = chunking.windows(rows).orderBy("chunk_seq").collect()
    assert [x["token_count"] for x in got] == sizes and [x["chunk_seq"] for x in got] == list(range(len(sizes)))


def test_window_arguments():
    with pytest.raises(ValueError):
        chunking.check_window(10, 10)


@pytest.mark.parametrize("line,want", [("Item 1", "Item 1"), ("ITEM 1A. Risk", "Item 1A"), ("Item 10", "Item 10"), ("## Item 7 x", "Item 7"), ("Item 8. | x", "Item 8"), ("Item 9C | x", None), ("Item 7 of this report", "Item 7"), ("see Item 7", None), ("Item 17", None)])
def test_headers(spark, line, want):
    assert spark.createDataFrame([(line,)], "x string").select(chunking.section_header(F.col("x"))).head()[0] == want


def test_contents_rows(spark):
    rows = spark.createDataFrame([("Item 9C | 40",), ("Item  1 | 3",), ("Item 9C text",)], "x string")
    assert [x[0] for x in rows.select(chunking.contents_row(F.col("x"))).collect()] == [True, True, False]


def test_main_document(spark):
    raw = "<DOCUMENT><TYPE>EX-1\n<TEXT>much longer exhibit text</TEXT></DOCUMENT><DOCUMENT><TYPE>10-K\n<TEXT>short</TEXT></DOCUMENT>"
    rows = spark.createDataFrame([(raw,), ("plain",), (raw.replace("10-K", "8-K"),)], "x string")
    assert [x[0] for x in rows.select(chunking.main_document(F.col("x"))).collect()] == ["short", "plain", "much longer exhibit text"]


def test_tables_are_cut_between_rows_only():
    row, prose = "a | b | c", "w " * 60
    big = "\n".join([row] * 200)
    assert [len(c) for c in chunking.table_aware(f"{prose}\n{big}\n{prose}")] == [60, 600, 400, 60]
    assert [len(c) for c in chunking.table_aware(f"few words\n{row}\n{prose}")] == [65]
    assert chunking.table_aware(f"{row}\n{row}") == [] and chunking.table_aware("") == []
    assert not chunking.is_table_row("a | b") and chunking.is_table_row("| a | b |")


def test_html():
    html = '<a href="x">Go</a><script>no()</script><style>p{}</style><table><tr><th>Name</th><td> 1 \n 2 </td><td></td></tr><tr><td></td></tr></table><p>End &amp; so</p>'
    assert chunking.html_text(html) == "Go\nName | 1 2\nEnd & so"
    assert chunking.html_text("<p>no table</p>") == "<p>no table</p>" and chunking.html_text(None) == ""


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"a": 1}', {"a": 1}),
        ('so: {"a": {"x"}} ok', {"a": {"name": "x"}}),
        ('{"a": [1, {"b": "c', {"a": [1, {"b": "c"}]}),
        ("[1, 2", [1, 2]),
        ("none", None),
        ('[{ "a" }, {"b": {"c"}}, "{\\"d\\"}"]', [{"name": "a"}, {"b": {"name": "c"}}, '{"d"}']),
        ('{"a": "b\\', None),
        ('{"a": "\\"b', {"a": '"b'}),
        ("[" * 100_000, None),
        ("", None),
    ],
)
def test_tolerant_json(text, want):
    assert extraction.json_within(text) == want


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20))
def test_repair_leaves_json_alone_and_closes_what_is_cut(value):
    text = json.dumps(value)
    assert extraction.repaired(text) == text
    assert all(extraction.repaired(text[:end]).startswith(text[:end]) for end in range(len(text)))
    if isinstance(value, str) and "\\" not in text:
        assert all(value.startswith(extraction.json_within(text[:end]).rstrip()) for end in range(1, len(text)))


def test_unwrapping_and_prose():
    assert extraction.unwrapped('<think>x</think>\n```json\n{"a":1}\n```') == '{"a":1}'
    assert extraction.unwrapped("<think>never closed") == ""
    assert extraction.after_json('{"a": "}"} ' + "prose " * 5) == "prose " * 5
    assert extraction.after_json('{"a": 1} short') == '{"a": 1} short' and extraction.after_json("plain") == "plain"


def test_metric_years_stand_before_the_value(spark):
    cases = [
        ("In 2023 x. In 2024 revenue was 391035 m", "391,035", "revenue", 2024),
        ("2023 Revenue, then 2024", "5 billion", "revenue", 2023),
        ("2023" + " " * 500 + "revenue 77", "77", "revenue", None),
        ("2021" + " " * 395 + "77", "77", "", 2021),
        ("2021" + " " * 396 + "77", "77", "", None),
        ("in 2022 of 2023 shares", "2023", "shares", 2022),
        ("in 12022 of 555", "555", "x", None),
        ("2024 revenue", "", "revenue", None),
        ("2024 revenue", None, "revenue", None),
        ("2024 nothing", "9", "revenue", None),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, text string, value string, name string, want long")
    got = rows.select("i", "want", extraction.metric_year(F.col("text"), F.col("value"), F.col("name")).alias("got")).collect()
    assert {x["i"]: x["got"] for x in got} == {x["i"]: x["want"] for x in got}


def test_typed_metrics_take_the_year_before_their_value(spark):
    output = '[{"source": "Apple", "relation": "reported_metric", "target": {"name": "Revenue", "value": "391,035"}}]'
    chunks = spark.createDataFrame([("c", "AAPL", 2025, "In 2023 revenue was 391035", output)], "chunk_id string, company_ticker string, fiscal_year long, text string, output string")
    assert "_2023_" in extraction.typed(extraction.parse(chunks), chunks).head()["dst"]
    assert "_2025_" in extraction.typed(extraction.parse(chunks), chunks.drop("text")).head()["dst"]


def test_aliases_find_companies_before_parts(spark):
    nodes = spark.createDataFrame([("Company", "AAPL"), ("Company", "Apple Growers"), ("RiskFactor", "apple shortage")], "label string, key string")
    asked = spark.createDataFrame([(1, "apple"), (2, "Growers")], "query_id long, candidate string")
    assert {tuple(r) for r in graph.find_entities(nodes, asked).collect()} == {(1, "apple", "Company", "AAPL"), (1, "apple", "RiskFactor", "apple shortage"), (2, "Growers", "Company", "Apple Growers")}


def test_triplets(spark):
    outputs = [
        ("c1", json.dumps({"results": [{"chunk_id": "c1", "triplets": [["Apple", "operates_in", "Services"], ["x"]]}, {"id": "c2", "triples": [{"source": {"name": "MSFT"}, "relation": "competes_with", "target": "Google"}]}]})),
        ("c3", json.dumps({"triplets": [{"source_entity": {"name": "Apple"}, "relation": "reported_metric", "target_entity": {"name": "Net Sales", "year": 2022}}, {"source": "a", "relation": "knows", "target": "b"}]})),
        ("c4", "{}"),
    ]
    rows = spark.createDataFrame(outputs, "chunk_id string, output string")
    chunks = spark.createDataFrame([(f"c{i}", "AAPL", 2024) for i in range(1, 5)], "chunk_id string, company_ticker string, fiscal_year long")
    got = {(x["chunk_id"], x["rel"], x["src"], x["dst"]) for x in extraction.typed(extraction.parse(rows), chunks).collect()}
    assert got == {("c1", "OPERATES_IN", "AAPL", "Services"), ("c2", "COMPETES_WITH", "MSFT", "GOOGL"), ("c3", "REPORTED_METRIC", "AAPL", "AAPL_2022_net_sales")}


def edges(spark, pairs):
    return spark.createDataFrame([("COMPETES_WITH", "Company", a, "Company", b) for a, b in pairs], "rel string, src_label string, src string, dst_label string, dst string")


def test_hops_with_a_cycle_and_fan_out(spark):
    start = spark.createDataFrame([(1, "Company", "a")], "query_id long, label string, key string")
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")])
    assert {(x["key"], x["depth"]) for x in graph.hops(e, start).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    wide = edges(spark, [("a", f"n{i:03d}") for i in range(60)])
    assert graph.hops(wide, start).count() == 51


def test_merges(spark):
    rows = spark.createDataFrame([("k", 1, "x", None), ("k", 2, None, 5), ("k", 3, None, None)], "key string, seq long, a string, b long")
    assert [tuple(x) for x in graph.merge_last(rows, ["key"], "seq").collect()] == [("k", "x", 5)]
    assert [tuple(x) for x in graph.merge_rows(rows, ["key"], "seq").collect()] == [("k", None, None)]
    nodes = spark.createDataFrame([("Company", "a"), ("Company", "b")], "label string, key string")
    assert graph.merge_edges(edges(spark, [("a", "b"), ("a", "b"), ("a", "zz")]), nodes).count() == 1


def test_communities(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 9)] + [(i, i + 1) for i in range(20, 40)], "a long, b long")
    got = {x["node"]: x["component"] for x in graph.connected(pairs).collect()}
    assert got[3] == 1 and got[6] == 5 and got[9] == 9 and got[40] == 20
    assert {x["community"] for x in graph.propagate_labels(pairs.filter("a < 10 AND a <> 9")).collect()} <= {1, 2, 5, 6}


def test_facts_without_noise(spark):
    start = spark.createDataFrame([(1, "Company", "AAPL")], "query_id long, label string, key string")
    got = graph.facts(edges(spark, [("AAPL", "MSFT"), ("AAPL", "Others")]), start).collect()
    assert [x["fact"] for x in got] == ["AAPL --COMPETES_WITH--> MSFT"]


def test_incremental(spark):
    batch = spark.createDataFrame([("a",), ("b",), ("b",)], "chunk_id string")
    assert incremental.new_rows(batch, batch.filter("chunk_id = 'a'"), "chunk_id").count() == 2
    rows = spark.createDataFrame([("A", 1), ("A", 2), (None, 1)], "company_ticker string, fiscal_year long")
    assert incremental.purge(rows, "A", 1).count() == 2
    links = spark.createDataFrame([("c1", "x"), ("c2", "A_1_sales"), ("c2", "y")], "src string, dst string")
    chunks = spark.createDataFrame([("c1", "A", 1), ("c2", "A", 2)], "chunk_id string, company_ticker string, fiscal_year long")
    assert [x["dst"] for x in incremental.purge_edges(links, chunks, "A", 1).collect()] == ["y"]


def test_dialogue(spark):
    rows = spark.createDataFrame([("añade AAPL 2024", "AAPL", 2024), ("no añadas AAPL 2024", "AAPL", 2024), ("añade AAPL", "AAPL", None), ("revenue of AAPL 2024", "AAPL", 2024)], "x string, t string, y long")
    assert [x[0] for x in rows.select(dialogue.intent(F.col("x"), F.col("t"), F.col("y"))).collect()] == ["ingest", "retrieve", "retrieve", "retrieve"]
    turns = spark.createDataFrame([(1, 0, "AAPL", 2024), (1, 2, None, 2023), (1, 4, None, None)], "conv_id long, turn long, ticker string, year long")
    assert [(x["ticker"], x["year"]) for x in dialogue.follow_up(turns).orderBy("turn").collect()] == [("AAPL", 2024), ("AAPL", 2023), ("AAPL", 2024)]
    news = spark.createDataFrame([(1, "h", "s", "X,BRK.B", 1), (2, "Apple up", "s", "", 5), (3, "h", "s", "", 9)], "item_id long, headline string, summary string, related string, at long")
    assert [(x["item_id"], x["relevance"]) for x in dialogue.news(news, "BRKB", ["APPLE", "x"]).collect()] == [(1, 3), (2, 1)]


def test_similarity_covers_items_of_short_words(spark, monkeypatch):
    monkeypatch.setattr(r, "ITEMS", 2)
    items = [(1, "a few short words"), (2, "Extraordinarily long"), (3, None), (4, "zzz"), (5, "")]
    docs = [(10, "words, SHORT few a"), (11, "long way"), (11, "long way"), (None, "a b"), (12, None), (13, "")]
    got = r.set_similarity(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 10, 1.0), (2, 11, 1 / 3), (2, 11, 1 / 3), (1, None, 0.2)], key=repr)


def test_index_of_odd_texts_and_many_words(spark, tmp_path, monkeypatch):
    """Null and wordless texts count among the chunks; more words than are sent give the same; an empty corpus has no hits."""
    texts = [(1, "red fox, red hen"), (2, "fox"), (3, None), (4, "?!"), (5, "hen owl"), (6, "RED ant")]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "red owl red"), (2, "none of these"), (3, None)], "query_id long, question string")
    index = r.build_index(chunks, str(tmp_path / "index"))
    assert (index.chunks, index.mean_length) == (6, 9 / 6)
    found = [tuple(x) for x in r.search(index, asked).orderBy("query_id", "rank").collect()]
    idf = lambda df: math.log(6 - df + 0.5) - math.log(df + 0.5)
    want = {1: 2 * idf(2) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 4 / 1.5)), 5: idf(1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 1.5)), 6: 2 * idf(2) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 1.5))}
    assert {x[1]: round(x[2], 9) for x in found} == {k: round(v, 9) for k, v in want.items()}
    assert [x[1] for x in found] == sorted(want, key=lambda k: -want[k])
    assert [(x[0], x[1], round(x[2], 9)) for x in r.bm25(chunks, asked).orderBy("query_id", "rank").collect()] == [(x[0], x[1], round(x[2], 9)) for x in found]
    monkeypatch.setattr(r, "ASKED", 1)
    again = r.read_index(spark, str(tmp_path / "index"))
    assert [(x[0], x[1], round(x[2], 9)) for x in r.search(again, asked).orderBy("query_id", "rank").collect()] == [(x[0], x[1], round(x[2], 9)) for x in found]
    assert r.bm25(chunks.limit(0), asked).count() == 0


def test_small_tables_are_dealt_and_large_ones_left(spark):
    from quernstone.workspace import spread

    small = spark.range(10)
    assert "Repartition" in spread(small)._jdf.queryExecution().optimizedPlan().toString()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1b")
    try:
        assert spread(small) is small
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_nearest_in_blocks_of_queries(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(40)], "chunk_id long, embedding array<float>")
    queries = vectors.filter("chunk_id < 9").selectExpr("chunk_id AS query_id", "embedding AS query_vector")
    order = lambda: sorted(tuple(x) for x in r.knn(vectors, queries, 4).collect())
    want = order()
    assert len(want) == 36
    monkeypatch.setattr(r, "VECTORS", 2)
    assert order() == want


def test_vectors_that_are_none_are_near_to_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "A", [1.0, 0.0]), (2, "B", None), (3, "A", [1.0]), (4, "A", [None, 1.0]), (5, "A", [nan, 0.0]), (6, "A", [inf, 0.0]), (7, "B", [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "chunk_id long, t string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0], ["B"]), (2, [1.0, 0.0], []), (3, None, [])], "query_id long, query_vector array<double>, only array<string>")
    near = lambda df: sorted((x["query_id"], x["rank"], x["chunk_id"]) for x in df.collect())
    assert near(r.knn(vectors, asked)) == [(1, 1, 1), (1, 2, 7), (2, 1, 1), (2, 2, 7)]
    assert near(r.knn(vectors, asked, by="t")) == [(1, 1, 7), (2, 1, 1), (2, 2, 7)]


def test_a_budget_keeps_the_nearest_and_first_nodes(spark):
    edges = spark.createDataFrame([("COMPETES_WITH", "Company", a, "Company", b) for a, b in (("a", "d"), ("a", "c"), ("a", "b"), ("b", "e"), ("b", "f"), ("c", "g"))], "rel string, src_label string, src string, dst_label string, dst string")
    start = spark.createDataFrame([(1, "Company", "a"), (2, "Company", "b")], "query_id long, label string, key string")
    got = lambda n: sorted((x["query_id"], x["depth"], x["key"]) for x in graph.hops(edges, start, most=n).collect())
    assert got(3) == [(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, 1, "b"), (2, 2, "e"), (2, 2, "f")]
    assert got(5) == [(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (1, 2, "d"), (1, 3, "e"), (2, 1, "b"), (2, 2, "e"), (2, 2, "f")]
    assert got(1) == [(1, 1, "a"), (2, 1, "b")]
