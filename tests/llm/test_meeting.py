"""A member meets its component's name once, however many signatures it shares."""

from quernstone.llm import jaccard, meeting


def test_names_join_one_row_for_each_member(spark, monkeypatch):
    plans, write = {}, meeting.materialize

    def spy(df, name, rows=None):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name, rows)

    monkeypatch.setattr(meeting, "materialize", spy)
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words[:i] + [f"x{i}"] + words[i + 1 :]) for i in range(10, 110, 10)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(99, "something else altogether that links with none")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(len(texts))} | {99: 99}
    named = plans["named"]
    assert named.index("Generate explode") < named.index("Join LeftOuter") < named.index("collect_list")


def test_sketches_join_one_row_for_each_member(spark, monkeypatch):
    plans, write = {}, meeting.materialize

    def spy(df, name, rows=None):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name, rows)

    monkeypatch.setattr(meeting, "materialize", spy)
    words = [f"w{i}" for i in range(120)]
    far = [" ".join(words[:40] + [f"{k}y{i}" for i in range(80)]) for k in range(3)]
    near = [" ".join(words[:i] + [f"x{i}"] + words[i + 1 :]) for i in range(10, 110, 10)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(spark.createDataFrame(list(enumerate(near + far)), "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(len(near))} | {i: i for i in range(len(near), len(near) + 3)}
    assert "Join" not in plans["weighed"]  # a member's signatures are counted where they are gathered
    cells = plans["rest"]
    assert cells.index("Generate inline") < cells.index("Join Inner, (node") < cells.index("collect_list")
