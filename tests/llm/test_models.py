"""Quality, language and nearest neighbours, by held-out accuracy and brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import forest, language, quality

from .texts import frame, rows, sentence

LETTERS = {"xx": "abcdefgh", "yy": "mnopqrst", "zz": "äöüßéèñç"}


def language_rows():
    r = random.Random(1)
    out = []
    for i in range(300):
        lang = list(LETTERS)[i % 3]
        text = " ".join("".join(r.choices(LETTERS[lang], k=r.randint(2, 7))) for _ in range(r.randint(3, 60)))
        out.append((i, text, lang, *[None] * 6))
    return out + [(900, None, "xx", *[None] * 6), (901, "", None, *[None] * 6), (902, "123 !!", "yy", *[None] * 6), (None, "abc def", None, *[None] * 6)]


def test_language_held_out_accuracy_and_edges(spark):
    docs = frame(spark, language_rows())
    model = language.fit(docs.filter(F.col("doc_id") % 4 != 2))
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    held = [r for r in language_rows() if r[0] is not None and r[0] % 4 == 2 and r[0] < 900]
    assert all(got[r[0]]["lang_pred"] == r[2] for r in held)
    for i in (900, 901, 902):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[None]["lang_pred"] == "xx" and all(0 <= r["score"] <= 1 for r in got.values())


def test_language_vectors_and_scores_equal_brute_force(spark):
    docs = frame(spark, language_rows())
    model = language.fit(docs.filter(F.col("doc_id") % 4 != 2), per_language=50, clusters=2)
    rows_ = [x[1] or "" for x in language_rows()]
    counts, has = language.grams(rows_)
    for i in (0, 7, 100):
        letters = "".join(c if c.isalpha() else " " for c in rows_[i].lower())
        n = len(" ".join(letters.split())) + 1
        assert counts[i].sum() == n + (n - 1) + (n - 2)
    got = {x["doc_id"]: x for x in language.predict(docs, model).collect()}
    for (doc, *_), c, h in zip(language_rows(), counts, has):
        if not h:
            continue
        v = np.log1p(c.astype(float)) * model["idf"]
        v /= np.linalg.norm(v)
        best = {}
        for centre, k in zip(model["centres"], model["of"]):
            best[model["langs"][k]] = max(best.get(model["langs"][k], -2), float(v @ centre))
        top = max(best.values())
        assert best[got[doc]["lang_pred"]] > top - 1e-5
        assert abs(got[doc]["score"] - 1 / sum(np.exp(20 * (b - top)) for b in best.values())) < 1e-4


def test_language_repeated_rows_and_long_texts(spark):
    data = language_rows()[:30] * 2 + [(500, "abc def " * 100_000, None, *[None] * 6)]
    model = language.fit(frame(spark, data))
    got = language.predict(frame(spark, data), model).collect()
    assert len(got) == 61 and len({(x["doc_id"], x["lang_pred"], x["score"]) for x in got}) == 31
    assert {x["lang_pred"] for x in got if x["doc_id"] == 500} == {"xx"}


def test_a_row_repeated_very_often_is_one_sample(spark):
    data = language_rows() + [language_rows()[0]] * 3000
    learn = frame(spark, data).filter(F.col("doc_id") % 4 != 2)
    model = language.fit(learn, per_language=40, clusters=3)
    assert len(model["centres"]) <= 3 * len(model["langs"])
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(frame(spark, language_rows()), model).collect()}
    held = [r for r in language_rows() if r[0] is not None and r[0] % 4 == 2 and r[0] < 900]
    assert np.mean([got[r[0]] == r[2] for r in held]) > 0.95


def test_language_without_labels_and_rows(spark):
    model = language.fit(frame(spark, []))
    assert language.predict(frame(spark, []), model).count() == 0
    assert {r["lang_pred"] for r in language.predict(frame(spark, language_rows()[:5]), model).collect()} == {"und"}


def quality_rows():
    r = random.Random(2)
    out, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        text = sentence(r, r.randint(20, 300)) + "."
        if not good:
            text = " ".join(w + r.choice("$%&#") * 3 for w in text.split())
        out.append((i, text, *[None] * 7))
        labels.append((i, int(good)))
    return out + [(900, None, *[None] * 7), (901, "", *[None] * 7), (902, "x" * 200_000, *[None] * 7)], labels + [(0, None), (None, 1), (12345, 0)]


def test_quality_held_out_accuracy_and_edges(spark):
    data, marks = quality_rows()
    docs, labels = frame(spark, data), spark.createDataFrame(marks, "doc_id long, quality int")
    model = quality.fit(docs, labels.filter(quality.fold() != 1))
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert len(got) == len(data) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    held = [(i, y) for i, y in marks[:400] if i % 5 == 1]
    assert np.mean([got[i]["predicted"] == y for i, y in held]) > 0.97
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_quality_without_labels_and_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(frame(spark), none) is None
    assert quality.keep(frame(spark), None).count() == len(rows())
    data, marks = quality_rows()
    model = quality.fit(frame(spark, data), spark.createDataFrame(marks, "doc_id long, quality int"))
    assert quality.score(frame(spark, []), model).count() == 0


def test_quality_gradients_equal_differences_of_the_loss():
    r = np.random.default_rng(0)
    count = np.array([1, 2, 3, 4, 1, 6])
    x, y, weight = r.normal(size=(count.sum(), 5)), np.array([0.0, 1, 1, 0, 1, 0]), r.uniform(0.5, 2, 6)
    starts = np.concatenate([[0], np.cumsum(count)[:-1]])
    m = quality.initial(x, 4, 3, 1)

    def loss():
        s = quality.forward(m, x, starts)["score"]
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / weight.sum()

    for name, grad in quality.gradients(m, x, count, y, weight).items():
        for i in np.ndindex(m[name].shape):
            m[name][i] += 1e-6
            up = loss()
            m[name][i] -= 2e-6
            down = loss()
            m[name][i] += 1e-6
            assert abs((up - down) / 2e-6 - grad[i]) < 1e-6, name


def test_quality_attention_equals_the_formula_passage_by_passage():
    r = np.random.default_rng(4)
    bags = [r.normal(size=(k, 5)) for k in (1, 3, 7)]
    m = quality.initial(np.concatenate(bags), 4, 3, 2)
    got = quality.forward(m, np.concatenate(bags), np.array([0, 1, 4]))["score"]
    for s, bag in zip(got, bags):
        h = [np.tanh(((p - m["mean"]) / m["std"]) @ m["E"] + m["e"]) for p in bag]
        a = np.array([np.exp(m["w"] @ (np.tanh(x @ m["V"]) / (1 + np.exp(-(x @ m["U"]))))) for x in h])
        bagged = sum(w * x for w, x in zip(a / a.sum(), h))
        assert s == 1 / (1 + np.exp(-(bagged @ m["c"] + m["b"][0]))) or abs(s - 1 / (1 + np.exp(-(bagged @ m["c"] + m["b"][0])))) < 1e-12


def test_quality_passages_count_characters_and_words():
    rows = ["Aa b!", "", "x " * 500, "same same other"]
    x, count = quality.passages(rows)
    assert count.tolist() == [1, 1, 3, 1] and x.shape == (6, quality.FEATURES)
    assert x[0, 1] == np.float32(2 / 5) and x[0, 2] == np.float32(1 / 5)
    assert not x[1, : quality.CLASSES].any()
    again = quality.FEATURES - quality.WORDS - 1
    assert x[5, again] == np.float32(1 / 3) and x[2, again] > 0.9
    assert np.allclose(x[[0, 2, 3, 4, 5], quality.FEATURES - quality.WORDS :].sum(1), 10)


def vectors(seed, n, dims=16):
    r = np.random.default_rng(seed)
    return [(i, r.normal(size=dims).astype(np.float32).tolist()) for i in range(n)]


def brute(data, asked, k):
    x = {i: np.array(v, np.float64) for i, v in data if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = {}
    for q in x:
        if asked(q):
            scored = sorted(((-float(np.cumsum(x[q] * v)[-1]), i) for i, v in x.items() if i != q))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_neighbours_recall_and_exact_scores(spark):
    data = vectors(1, 1500)
    got = found(forest.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=10, leaf=64))
    want = brute(data, lambda i: i % 20 == 0, 10)
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
    x = {i: np.array(v, np.float64) for i, v in data}
    assert all(s == float(np.cumsum(x[q] * x[i])[-1]) for q, own in got.items() for i, s in own)
    assert all([s for _, s in own] == sorted((s for _, s in own), reverse=True) for own in got.values())


def test_neighbours_ties_hot_vectors_and_bad_rows(spark):
    same = [1.0, 2.0, 3.0]
    data = [(i, same) for i in range(200)] + [(300, [0.0, 0.0, 0.0]), (301, None), (302, [1.0, None, 2.0]), (303, [float("nan"), 1.0, 1.0]), (304, [float("inf"), 1.0, 1.0]), (305, []), (306, [2.0, 2.0, 3.0]), (307, [1.0, 1.0])]
    got = found(forest.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=20))
    assert got == brute([d for d in data if d[0] < 307], lambda i: i % 20 == 0, 20)


def test_neighbours_of_doubles_and_ties_at_the_cut(spark):
    r = np.random.default_rng(3)
    data = [(i, (r.normal(size=8) + 1e-12 * r.normal(size=8)).tolist()) for i in range(120)]
    data += [(1000 + i, [1.0, float(i), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(80)] + [(2000, [3.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert found(forest.nearest(df, F.col("vec_id") == 2000, k=20, recall=1.0)) == brute(data, lambda i: i == 2000, 20)


def test_neighbours_by_pieces_copies_and_flushes(spark, monkeypatch):
    r = np.random.default_rng(5)
    near = r.normal(size=16)  # half of all rows, and of the queries, about one point
    data = [(i, (r.normal(size=16) if i % 2 else near + 1e-4 * r.normal(size=16)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    want = found(forest.nearest(df, F.col("vec_id") % 3 == 0, k=10, leaf=100))
    for name, small in (("PIECE", 30), ("VISITS", 20), ("HELD", 10), ("TASK", 2000)):
        monkeypatch.setattr(forest, name, small)
    assert found(forest.nearest(df, F.col("vec_id") % 3 == 0, k=10, leaf=100)) == want
    true = brute(data, lambda i: i % 3 == 0, 10)
    assert np.mean([len({i for i, _ in want[q]} & {i for i, _ in true[q]}) / 10 for q in true]) >= 0.9


def test_neighbours_of_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert forest.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    assert forest.nearest(spark.createDataFrame([(0, [1.0, 0.0])], schema), F.col("vec_id") % 20 == 0).count() == 0
    assert found(forest.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], schema), F.col("vec_id") % 20 == 0)) == {0: [(1, 0.5)]}
