"""Stored vectors by cells against exact search over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from quernstone.operators import vector_cells
from quernstone.operators.retrieval import knn


@pytest.fixture(scope="module")
def made():
    """Twelve groups far from each other, with copies, and rows without a usable vector."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        g = i % 12
        rows.append((i, [100.0 * (g % 4) + rng.random(), 100.0 * (g // 4) + rng.random(), rng.random()], i % 5))
    rows += [(600 + i, rows[i % 3][1], 9) for i in range(40)]
    rows += [(700, None, 1), (701, [1.0, float("nan"), 0.0], 1), (702, [1.0, None, 2.0], 2), (703, [5.0, 5.0], 3), (704, [], 3), (705, [float("inf"), 0.0, 0.0], 4)]
    return rows


@pytest.fixture(scope="module")
def vectors(spark, made):
    return spark.createDataFrame(made, "chunk_id long, embedding array<float>, label int")


@pytest.fixture(scope="module")
def path(spark, vectors, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("cells") / "vectors")
    vector_cells.store(vectors, at, ["label", "chunk_id"], rows=20)
    return at


@pytest.fixture(scope="module")
def queries(spark):
    data = [(1, [0.5, 0.5, 0.5]), (2, [300.0, 200.0, 0.0]), (3, [150.0, 50.0, 9.0]), (4, [5.0, 5.0]), (5, None), (6, [float("nan"), 0.0, 0.0])]
    return spark.createDataFrame(data, "query_id long, query_vector array<float>")


def listed(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["distance"], 9)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 15, 70, 1000])
def test_answers_equal_search_over_all(spark, vectors, path, queries, k):
    got, _ = vector_cells.search(spark, path, queries, k)
    assert listed(got) == listed(knn(vectors, queries, k))


def test_filter_and_cells_that_are_not_read(spark, vectors, path, queries):
    got, read = vector_cells.search(spark, path, queries, 5, keep=F.col("label") == 9)
    assert listed(got) == listed(knn(vectors, queries, 5, keep=F.col("label") == 9))
    _, read = vector_cells.search(spark, path, queries.filter("query_id < 3"), 5)
    n = spark.read.parquet(f"{path}/cells").count()
    visits = read.groupBy("query_id").count().collect()
    assert n > 10 and len(visits) == 2 and all(r["count"] < n / 2 for r in visits)


def test_every_row_is_stored_and_radius_holds(spark, vectors, path, made):
    rows = spark.read.parquet(f"{path}/rows")
    assert sorted(r[0] for r in rows.select("chunk_id").collect()) == sorted(r[0] for r in made)
    assert {r[0] for r in rows.filter("cell = -1").select("chunk_id").collect()} == {700, 701, 702, 703, 704, 705}
    plan = rows.filter("cell = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan


def test_empty_tables_and_taken_name(spark, vectors, queries, tmp_path):
    at = str(tmp_path / "none")
    vector_cells.store(vectors.limit(0), at)
    with pytest.raises(ValueError):
        vector_cells.store(vectors.withColumn("cell", F.lit(1)), at)
    full = str(tmp_path / "bad")
    vector_cells.store(vectors.filter("chunk_id in (700, 701)"), full)
    assert vector_cells.search(spark, full, queries)[0].count() == 0


def test_bits_are_taken_in_turn(spark):
    df = spark.createDataFrame([(a, b) for a in range(8) for b in range(8)], "a int, b long")
    for r in df.select("a", "b", vector_cells.interleaved([F.col("a"), F.col("b")], 3).alias("z")).collect():
        assert r["z"] == sum(((r["a"] >> i) & 1) << (2 * i) | ((r["b"] >> i) & 1) << (2 * i + 1) for i in range(3))
