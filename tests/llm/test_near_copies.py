"""Jaccard join, line deduplication and decontamination against brute force."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quernstone.llm import contamination, jaccard, lines
from quernstone.llm.kernels import shingles, utf8

from .texts import edited, frame, rows, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(1, len(words))))}


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def components(keys, links):
    parent = {k: k for k in keys}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {k: find(parent, k) for k in keys}


@pytest.mark.parametrize("text", [None, "", "a", "A b", "a b c d e", "a\tb\x0bc  d e f g a b c d e", "é ü x y z w\nq"])
def test_shingle_hashes_count_like_sets(text):
    values, bounds = shingles(*utf8(pa.array(["p q r s t u", text, None])))
    assert bounds[2] - bounds[1] == len(shingle_set(text))
    assert bounds[1] == 2 and bounds[3] == bounds[2]


def test_jaccard_classes_equal_brute_force(spark):
    data = rows()
    sets = {r[0]: shingle_set(r[1]) for r in data}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(frame(spark)).collect()}
    assert got == {k: (len(sets[k]), want[k]) for k in sets}


def test_a_family_whose_members_are_unlike_is_joined_through_its_original(spark):
    r = random.Random(3)
    base = sentence(r, 120)
    data = [(i, edited(r, base, 4) if i else base, None, None, 0, "", 0, "", 0) for i in range(60)]
    sets = {x[0]: shingle_set(x[1]) for x in data}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert {x["doc_id"]: x["component_id"] for x in jaccard.classes(frame(spark, data)).collect()} == components(sets, links)


def test_no_pair_at_the_threshold_lacks_a_signature():
    r = np.random.default_rng(2)
    for n, apart in ((8, 1), (14, 2), (30, 4), (60, 8), (100, 14), (300, 42)):
        values, bounds = [], [0]
        for _ in range(50):
            h = r.integers(0, 2**63, n + 2 * apart).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for own in (h[:n], np.concatenate([h[apart:n], h[n : n + apart]])):
                values.append(np.sort(own))
                bounds.append(bounds[-1] + n)
        sig, of = jaccard.signatures(np.concatenate(values), np.array(bounds), 75)
        assert all(len(np.intersect1d(sig[of == 2 * k], sig[of == 2 * k + 1])) for k in range(50)), n


@pytest.mark.parametrize("common", [0, 300])
def test_every_pair_of_short_sets_shares_a_signature(common):
    r = np.random.default_rng(6)
    sizes = (*range(1, 61), 66, 67, 88, 89, 117, 156, 208, 209, 277)
    cases = [(m, n) for m in sizes for n in sorted({m, m + 1, (m + m * 4 // 3) // 2, m * 4 // 3})]
    for m, n in cases:
        both = -(-75 * (m + n) // 175)
        if both > m:
            continue
        pairs = 2000 if m <= 20 else 100
        values, bounds, often = [], [0], []
        for _ in range(pairs):
            h = r.permutation(r.integers(0, 2**63, m + n - both).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            often.append(h[: common * m // 1000])
            for own in (h[:m], h[m - both :]):
                values.append(np.sort(own))
                bounds.append(bounds[-1] + len(own))
        sig, of = jaccard.signatures(np.concatenate(values), np.array(bounds), 75, *([np.sort(np.concatenate(often))] if common else []))
        sides = [set(zip((of[of % 2 == k] // 2).tolist(), sig[of % 2 == k].tolist())) for k in (0, 1)]
        assert len({k for k, _ in sides[0] & sides[1]}) == pairs, (m, n)


@pytest.mark.parametrize("m", [278, 420, 700, 1100])
def test_all_parts_miss_no_pair_of_long_sets(m):
    r = np.random.default_rng(m)
    for n in (m, m * 4 // 3):
        both, pairs = -(-75 * (m + n) // 175), 60
        values, bounds = [], [0]
        for _ in range(pairs):
            h = r.integers(0, 2**63, m + n - both).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for own in (h[:m], h[m - both :]):
                values.append(np.sort(own))
                bounds.append(bounds[-1] + len(own))
        for parts in (None, jaccard.PARTS):
            sig, of = jaccard.signatures(np.concatenate(values), np.array(bounds), 75, parts=parts)
            sides = [set(zip((of[of % 2 == k] // 2).tolist(), sig[of % 2 == k].tolist())) for k in (0, 1)]
            assert len({k for k, _ in sides[0] & sides[1]}) == pairs


@pytest.mark.parametrize("m, n, both", [(14, 11, 11), (15, 13, 12), (16, 12, 12), (20, 15, 15), (21, 21, 18)])
def test_no_pair_of_unequal_sets_at_the_threshold_is_missed(m, n, both):
    r = np.random.default_rng(m)
    values, bounds = [], [0]
    for _ in range(40_000):
        h = r.integers(0, 2**63, m + n - both).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for own in (h[:m], h[m - both :]):
            values.append(np.sort(own))
            bounds.append(bounds[-1] + len(own))
    sig, of = jaccard.signatures(np.concatenate(values), np.array(bounds), 75)
    sides = [set(zip((of[of % 2 == k] // 2).tolist(), sig[of % 2 == k].tolist())) for k in (0, 1)]
    assert len({k for k, _ in sides[0] & sides[1]}) == 40_000


def test_all_parts_withhold_only_signatures_of_few_elements():
    r = np.random.default_rng(1)
    values, bounds = np.sort(r.integers(0, 2**63, 1500).astype(np.uint64)), np.array([0, 1500])
    every, some = (jaccard.enumerated(values, bounds, 75, parts) for parts in (None, jaccard.PARTS))
    assert len(every[0]) > 3 * len(some[0]) and set(some[0]) < set(every[0])
    assert every[2].all() and not some[2].any()
    assert len(every[0]) <= jaccard.expected(np.array([1500]), 75, None)[0] - jaccard.prefix_of(np.array([1500]), 75)[0]


def test_keep_first_keeps_one_of_each_class_and_all_columns(spark):
    docs = frame(spark)
    classes = {r["component_id"] for r in jaccard.classes(docs).collect()}
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(classes)


def test_keep_first_leaves_clashing_names_and_map_columns_alone(spark):
    schema = "doc_id long, text string, _text string, _doc int, _hash string, _row int, root int, tags map<string,int>"
    data = [(1, "a b c d e f", "mine1", 1, "h1", 1, 1, {"x": 1}), (1, "a b c d e f", "mine1", 1, "h1", 1, 1, {"y": 2}), (2, "a b c d e f", "mine2", 2, "h2", 2, 2, None), (3, "other", "mine3", 3, None, 3, 3, {})]
    kept = jaccard.keep_first(spark.createDataFrame(data, schema))
    assert kept.columns == [x.split()[0] for x in schema.split(", ")]
    got = {r["doc_id"]: r.asDict() for r in kept.collect()}
    assert sorted(got) == [1, 3] and kept.count() == 2
    assert (got[1]["_text"], got[1]["_doc"], got[1]["_hash"], got[1]["_row"]) == ("mine1", 1, "h1", 1) and got[1]["tags"] in ({"x": 1}, {"y": 2})
    assert got[3]["_text"] == "mine3" and got[3]["tags"] == {}


def test_jaccard_empty_table_and_null_ids(spark):
    assert jaccard.classes(frame(spark, [])).count() == 0
    data = [(None, "a b c d e f", *[None] * 7), (7, "a b c d e f", *[None] * 7), (7, "a b c d e f", *[None] * 7)]
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.classes(frame(spark, data)).collect()} == {(None, 7), (7, 7)}
    assert jaccard.keep_first(frame(spark, data[1:])).count() == 1


def test_keep_first_goes_by_rows_of_a_class_not_by_doc_id(spark):
    r = random.Random(12)
    base, clean, other, nulls = (sentence(r, 60) for _ in range(4))
    copy = " ".join(base.split(" ")[:-1])
    texts = [(1, base), (1, base), (2, copy), (2, clean), (None, copy), (None, other), (None, nulls), (None, nulls), (None, nulls + " x"), (5, ""), (5, ""), (None, None), (None, None), (7, sentence(r, 50)), (7, sentence(r, 50))]
    data = [(i, t, *[None] * 5, "clash", k) for k, (i, t) in enumerate(texts)]
    kept = jaccard.keep_first(frame(spark, data))
    assert kept.columns == frame(spark, data).columns
    got = sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=repr)
    left = [x for x in got if x[0] is not None or not (x[1] or "").startswith(nulls)]
    assert left == sorted([texts[k] for k in (0, 3, 5, 9, 10, 11, 12, 13, 14)], key=repr)
    assert len(got) == len(left) + 1


def mutated(r, s, n):
    s = list(s)
    for _ in range(n):
        i = r.randrange(len(s) + 1)
        s[i : i + r.randint(0, 1)] = r.choices("abé ", k=r.randint(0, 1))
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 4])
def test_banded_distance_equals_the_table(edits):
    r = random.Random(edits)
    left = ["".join(r.choices("abcé", k=r.randint(0, 70))) + "x" for _ in range(1500)]
    right = [mutated(r, s, r.randint(0, edits + 3)) for s in left]
    assert lines.within(left, right, edits).tolist() == [lines.distance(a, b) <= edits for a, b in zip(left, right)]


def allowed(a, b):
    return min(2, min(len(a), len(b)) // 12)


def test_lines_within_the_distance_share_a_signature():
    r = random.Random(9)
    met = 0
    for _ in range(3000):
        a = "".join(r.choices("abcdefgh", k=r.randint(10, 90)))
        b = mutated(r, a, 2)
        if a != b and lines.distance(a, b) <= allowed(a, b):
            sig, of = lines.signatures([a, b], 2)
            assert set(sig[of == 0]) & set(sig[of == 1]), (a, b)
            met += 1
    assert met > 1000


def test_sketches_rule_out_no_near_copy():
    r = random.Random(2)
    possible = lines._possible(2, 12)
    for _ in range(1500):
        a = "".join(r.choices("abcdefgh é", k=r.randint(10, 90)))
        b = mutated(r, a, r.randint(0, 3))
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a, b])], ["line_id", "line"])
        (got,) = lines._sketches([batch])
        sketch = np.frombuffer(b"".join(got.column(2).to_pylist()), np.uint8).reshape(2, -1)
        n = np.array([len(a), len(b)])
        if lines.distance(a, b) <= allowed(a, b):
            assert possible(sketch[:1], n[:1], sketch[1:], n[1:])[0]


def line_docs():
    r = random.Random(4)
    long_ = [sentence(r, 12) for _ in range(30)]
    texts = []
    for i in range(40):
        own = [r.choice(long_) if r.random() < 0.6 else sentence(r, 10) for _ in range(6)] + ["short", "", mutated(r, "fourteen chars", i % 3)]
        texts.append("\n".join(mutated(r, x, r.randint(0, 2)) if len(x) > 30 else x for x in own))
    texts += [None, "", "\n\n", "x" * 5000, "x" * 5001, "short"]
    return [(i, t, *[None] * 7) for i, t in enumerate(texts)]


def expected_lines(data):
    own = sorted({x for r in data for x in (r[1] or "").split("\n") if x.strip()})
    links = [(a, b) for a, b in itertools.combinations(own, 2) if abs(len(a) - len(b)) <= 2 and lines.distance(a, b) <= allowed(a, b)]
    root, seen, out = components(own, links), set(), {}
    for doc, text, *_ in data:
        places = [] if text is None else text.split("\n")
        dropped = []
        for i, x in enumerate(places):
            if x.strip():
                dropped += [i] if root[x] in seen else []
                seen.add(root[x])
        out[doc] = (len(places), len(places) - len(dropped), dropped)
    return out


def test_lines_equal_brute_force(spark):
    data = line_docs()
    want = expected_lines(data)
    got = lines.decide(frame(spark, data))
    assert {r["doc_id"]: (r["n_lines"], r["n_kept"], list(r["dropped"])) for r in got.collect()} == want
    cleaned = lines.apply(frame(spark, data))
    assert cleaned.columns == frame(spark, data).columns
    for r in cleaned.collect():
        source = data[r["doc_id"]][1]
        kept = None if source is None else "\n".join(x for i, x in enumerate(source.split("\n")) if i not in want[r["doc_id"]][2])
        assert r["text"] == kept


def test_lines_of_repeated_and_null_ids_belong_to_their_rows(spark):
    r = random.Random(5)
    one, two, three = (sentence(r, 8) for _ in range(3))
    texts = [(5, f"{one}\n{two}"), (5, f"{one}\n{two}"), (6, three), (6, one), (None, one), (None, None), (None, f"{three}\n{three}x")]
    data = [(i, t, *[None] * 5, "clash", k) for k, (i, t) in enumerate(texts)]
    got = lines.decide(frame(spark, data)).collect()
    assert sorted(((x["doc_id"], x["n_lines"], x["n_kept"], list(x["dropped"])) for x in got), key=repr) == sorted(
        [(5, 2, 2, []), (5, 2, 0, [0, 1]), (6, 1, 1, []), (6, 1, 0, [0]), (None, 1, 0, [0]), (None, 0, 0, []), (None, 2, 0, [0, 1])], key=repr
    )
    out = lines.apply(frame(spark, data))
    assert out.columns == frame(spark, data).columns
    assert sorted(((x["doc_id"], x["text"]) for x in out.collect()), key=repr) == sorted([(5, f"{one}\n{two}"), (5, ""), (6, three), (6, ""), (None, ""), (None, None), (None, "")], key=repr)


def test_lines_of_an_empty_table(spark):
    assert lines.decide(frame(spark, [])).count() == 0


def test_leaks_equal_brute_force(spark):
    r = random.Random(8)
    items = [(i, sentence(r, r.randint(5, 60))) for i in range(25)] + [(90, None), (91, ""), (92, "one"), (93, "One two three"), (94, sentence(r, 20)), (94, sentence(r, 20))]
    texts = [sentence(r, r.randint(5, 3000)) for _ in range(60)]
    for k in range(40):
        i, item = r.randrange(60), items[r.randrange(25)][1]
        texts[i] += " " + edited(r, item.upper(), r.choice([0, 0, 1, 2])) + "\n" + sentence(r, 20)
    data = [(i, t, *[None] * 7) for i, t in enumerate([*texts, None, "", "one", "one two THREE"])]
    want = {(d[0], i) for d in data for i, t in items if (q := shingle_set(t)) and 100 * len(q & shingle_set(d[1])) >= 75 * len(q)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in contamination.leaks(frame(spark, data), bench).collect()} == want and len(want) > 20
    clean = contamination.clean(frame(spark, data), bench)
    assert sorted(x["doc_id"] for x in clean.collect()) == sorted({d[0] for d in data} - {d for d, _ in want})
    assert clean.columns == frame(spark, data).columns


def test_leaks_do_not_depend_on_what_is_sent_to_all_tasks(spark, monkeypatch):
    r = random.Random(3)
    items = spark.createDataFrame([(i, sentence(r, 12)) for i in range(5)] + [(None, sentence(r, 9))], "item_id long, text string")
    texts = [x["text"] for x in items.collect()]
    data = [(i, sentence(r, 30) + (" " + texts[i % 6] if i % 3 else ""), *[None] * 7) for i in range(60)] + [(None, texts[0], *[None] * 7)] * 30
    docs = frame(spark, data)
    one = sorted(map(tuple, contamination.leaks(docs, items).collect()), key=repr)
    kept = sorted((x["doc_id"] for x in contamination.clean(docs, items).collect()), key=repr)
    monkeypatch.setattr(contamination, "SENT", 0)
    assert sorted(map(tuple, contamination.leaks(docs, items).collect()), key=repr) == one and len(one) == 70
    assert sorted((x["doc_id"] for x in contamination.clean(docs, items).collect()), key=repr) == kept == sorted(range(0, 60, 3), key=repr)


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.leaks(frame(spark), none).count() == 0
    assert contamination.clean(frame(spark), none).count() == frame(spark).count()
    assert contamination.leaks(frame(spark, []), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
