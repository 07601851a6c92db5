"""The pipeline's stages, each on what the one before kept."""

import random

import corpus_pipeline

from quernstone.llm import contamination

from .texts import edited, frame, sentence


def test_stages_take_effect(spark, tmp_path):
    r = random.Random(6)
    item = sentence(r, 30)
    texts = [sentence(r, r.randint(30, 120)) for _ in range(200)]
    bad = {i for i in range(0, 200, 5)}
    texts = [" ".join(w + "$$$" for w in t.split()) if i in bad else t for i, t in enumerate(texts)]
    texts += [edited(r, texts[1], 1), texts[2], texts[3] + " " + item]
    data = [(i, t, "en", ("a", "b")[i % 2], len(t), "clash", 0, "clash", 0) for i, t in enumerate(texts)]
    folder = str(tmp_path)
    frame(spark, data).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen, columns = [], docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            seen.append(sorted(x["doc_id"] for x in docs.collect()))
    good = set(range(203)) - bad
    assert set(seen[0]) == good
    assert set(seen[1]) == good - {200, 201}
    assert set(seen[2]) == good - {200, 201, 202}
    assert set(seen[3]) <= set(seen[2]) and len(seen[3]) > len(seen[2])
    assert docs.count() == len(seen[3]) and docs.agg({"shard": "max"}).head()[0] <= 39
    assert contamination.leaks(spark.read.parquet(f"{folder}/stage2"), spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 0


def test_an_empty_table_runs_through(spark, tmp_path):
    folder = str(tmp_path)
    frame(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
