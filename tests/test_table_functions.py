"""Table functions against the operators that do the same."""

import pytest

from quernstone.functions import table_functions
from quernstone.operators import chunking, extraction

#: Model outputs in every shape the parser knows.
OUTPUTS = (
    ("c1", 'AAPL', 2024, '<think>hm</think>```json\n{"triplets": [{"source": {"name": "Apple"}, "relation": "operates_in", "target": {"name": "Services Segment"}}]}\n```'),
    ("c2", 'MSFT', 2024, '{"triplets": [["Microsoft", "competes_with", "Google"], ["too short"], {"source_entity": "MS,FT", "relation": "REPORTED_METRIC", "target_entity": {"name": "Net Income", "value": "88", "year": "2023"}}'),
    ("c3", 'AMZN', 2025, 'Here you are: {"source": {"Amazon.com"}, "relation": "operates_in", "target": {"Cloud"}} done'),
    ("c4", 'NVDA', 2025, '[{"source": "AI boom", "relation": "impacts_revenue", "target": "Revenue"}, {"source": "x", "relation": "likes", "target": "y"}]'),
    ("c5", 'META', 2024, 'no json here'),
    ("c6", 'META', 2024, '{"source": "Facebook", "relation": "competes_with", "target": "Meta Platforms"}'),
)


@pytest.fixture
def docs(spark):
    table_functions.register(spark)
    text = lambda n: " ".join(f"w{i}" for i in range(n))
    data = [(1, text(30), "A", 2024, "Item 1", "x"), (2, text(75), "A", 2024, None, "y"), (3, text(400), "B", None, "Item 7", None), (4, None, "B", 2025, "Item 7", "z"), (5, text(9) + " \n\t" + text(40), None, 2025, "Item 7", "z")]
    df = spark.createDataFrame(data, "doc_id long, text string, company_ticker string, fiscal_year long, section_id string, extra string")
    df.createOrReplaceTempView("some_docs")
    return df


def found(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def test_chunks_of_any_table(spark, docs):
    for by in ("", "PARTITION BY company_ticker ORDER BY doc_id"):
        got = spark.sql(f"SELECT * FROM chunks(TABLE(some_docs) {by}, size => 60, overlap => 10, least => 20)")
        assert found(got) == found(chunking.windows(docs, 60, 10, 20))
    assert found(spark.sql("SELECT * FROM chunks(TABLE(some_docs))")) == found(chunking.windows(docs))


def test_wrong_arguments_are_refused_when_a_query_is_analysed(spark, docs):
    for call in ("TABLE(SELECT doc_id FROM some_docs)", "TABLE(some_docs), size => 10, overlap => 10"):
        with pytest.raises(Exception, match="no column|overlap"):
            spark.sql(f"SELECT * FROM chunks({call})")


def test_triplets_of_model_outputs(spark):
    table_functions.register(spark)
    rows = spark.createDataFrame(list(OUTPUTS), "chunk_id string, ticker string, year long, output string")
    rows.createOrReplaceTempView("outputs")
    got = spark.sql("SELECT chunk_id, relation, source, source_props, target, target_props FROM triplets(TABLE(outputs))")
    assert found(got) == found(extraction.parse(rows)) and got.count() > 4
    assert spark.sql("SELECT DISTINCT ticker FROM triplets(TABLE(outputs))").count() > 2
