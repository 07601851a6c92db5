"""The hold-back filter against the batch one, and as a stream."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quernstone.operators.extraction import after_json
from quernstone.streaming import holdback as h

TEXTS = [
    '{"answer": {"a": [1, "}"]}, "q": "\\"{"}\n\n The answer is forty-two, as is known.',
    '{"answer": 1} short',
    '{"answer": 1}' + " " * 30,
    "  plain prose with {braces} in it",
    ' \n\t {"open": "never closed } ',
    '{"a": 1}{"b": 2} and then quite a bit of prose follows',
    "",
    "   ",
    "{",
    "}",
    '{"é": "\\\\"} éé and twenty characters of text and more',
]


def pieces(text, cuts):
    ends = [0, *sorted(cuts), len(text)]
    return [text[i:j] for i, j in zip(ends, ends[1:])]


@pytest.mark.parametrize("text", TEXTS)
def test_every_split_gives_the_batch_result(text):
    r = random.Random(1)
    splits = [[i] for i in range(len(text) + 1)] + [r.choices(range(len(text) + 1), k=r.randint(0, 12)) for _ in range(60)] + [list(range(len(text)))]
    for cuts in splits:
        held, out = h.Held(), ""
        for token in pieces(text, cuts):
            held, more = h.feed(held, token)
            out += more
        assert out + h.flush(held) == after_json(text)


def test_prose_is_released_at_once_and_a_preface_never():
    held, out = h.feed(h.Held(), "Hello ")
    assert out == "Hello " and h.feed(held, '{"x"')[1] == '{"x"'
    held, out = h.feed(h.Held(), '{"secret": 1} ')
    assert out == ""
    assert h.feed(held, "and now the prose begins here")[1] == "and now the prose begins here"


def test_stream_of_tokens_over_several_batches(spark, tmp_path):
    r = random.Random(2)
    events = []
    for i, text in enumerate(TEXTS):
        tokens = pieces(text, r.choices(range(len(text) + 1), k=6))
        events += [(f"a{i}", k, t, k == len(tokens) - 1) for k, t in enumerate(tokens)]
    events.append(("a0", 1, "repeated", False))
    schema = "answer string, seq long, token string, last boolean"
    for part in range(3):
        rows = [e for e in events if e[1] % 9 // 3 == part]
        r.shuffle(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = h.released(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("answer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))
    got = {x["answer"]: x["text"] for x in got.collect()}
    assert {k: v for k, v in got.items() if v} == {f"a{i}": after_json(t) for i, t in enumerate(TEXTS) if after_json(t)}


def test_an_idle_answer_is_shown_and_goes_on(spark, tmp_path):
    schema = "answer string, seq long, token string, last boolean"
    spark.createDataFrame([("a", 0, '{"never": ', False)], schema).write.parquet(str(tmp_path / "in/p0"))
    stream = h.released(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), idle_ms=500)
    query = stream.writeStream.format("memory").queryName("shown").trigger(processingTime="200 milliseconds").start()
    try:
        seen = lambda n: any(spark.table("shown").count() >= n or time.sleep(0.5) for _ in range(60))
        assert seen(1)
        spark.createDataFrame([("a", 1, "closed", True)], schema).write.parquet(str(tmp_path / "in/p1"))
        assert seen(2)
        assert [r["text"] for r in spark.table("shown").orderBy("seq").collect()] == ['{"never": ', "closed"]
    finally:
        query.stop()


def test_many_answers_take_few_calls(spark, tmp_path):
    """Over two batches; half of the answers begin in the first and end in the second, and ids are numbers."""
    schema = "answer long, seq long, token string, last boolean"
    text = lambda i: f'{{"n": {i}}} and then twenty characters of prose' if i % 3 else f"plain {i}"
    n, half = 6000, 10
    cut = lambda i: [(i, 0, text(i)[:half], False), (i, 1, text(i)[half:], True)]
    rows = [r for i in range(n) for r in cut(i)]
    for part in range(2):
        spark.createDataFrame([r for r in rows if (r[1] and r[0] % 2) == part], schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = h.released(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("answer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))
    assert {x["answer"]: x["text"] for x in got.collect()} == {i: after_json(text(i)) for i in range(n)}
    states = [s["numRowsUpdated"] for p in query.recentProgress for s in p["stateOperators"]]
    assert 0 < sum(states) <= 2 * h.BUCKETS < n
