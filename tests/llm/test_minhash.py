"""MinHash near duplicates against brute force."""

import itertools
import random

import numpy as np

from quernstone.llm import minhash
from quernstone.llm.kernels import U64

from .test_near_copies import WORD, components
from .texts import edited, frame, rows, sentence


def shingle_set(text, width=4):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, min(1, len(words))))}


def brute(data):
    sets = {r[0]: shingle_set(r[1]) for r in data}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    names = components(sets, links)
    return {k: (len(sets[k]), names[k], names[k] == k) for k in sets}


def pairs(r, n, similarity, count):
    """Pairs of sets of about ``n`` hashes with a similarity as near as can be."""
    both = round(2 * n * similarity / (1 + similarity))
    values, bounds = [], [0]
    for _ in range(count):
        h = r.integers(0, 2**63, 2 * n - both).astype(U64) * U64(0x9E3779B97F4A7C15)
        for own in (h[:n], h[n - both :]):
            values.append(np.sort(own))
            bounds.append(bounds[-1] + n)
    return np.concatenate(values), np.array(bounds), both / (2 * n - both)


def test_classes_equal_brute_force(spark):
    data = rows()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.classes(frame(spark)).collect()}
    assert got == brute(data)


def test_pairs_at_the_threshold_link_whatever_their_size(spark):
    r = random.Random(4)
    data = []
    for n in (4, 5, 8, 9, 12, 13, 30, 31, 90, 91, 300):
        text = sentence(r, n)
        for more in range(0, n // 2 + 2, max(1, n // 12)):
            data += [(len(data) + k, t, *[None] * 7) for k, t in enumerate((text + " " + sentence(r, more), edited(r, text, 1)))]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in minhash.classes(frame(spark, data)).collect()}
    assert got == brute(data)


def test_every_coordinate_is_filled_and_empty_sets_have_none():
    values = np.sort(np.random.default_rng(1).integers(0, 2**63, 1003).astype(U64))
    sketch = minhash.sketches(values, np.array([0, 1, 1, 3, 1003]))
    assert (sketch[[0, 2, 3]] != minhash._EMPTY).all() and (sketch[1] == minhash._EMPTY).all()
    assert (sketch[0] >> U64(minhash._VALUE)).max() >= minhash.SIZE and (sketch[3] >> U64(minhash._VALUE)).max() < 8
    assert 1 not in minhash.bands(values, np.array([0, 1, 1, 3, 1003]))[1]


def test_coordinates_agree_as_often_as_sets_are_alike():
    r = np.random.default_rng(2)
    for n in (5, 20, 160, 900):
        for similarity in (0.2, 0.5, 0.8):
            values, bounds, true = pairs(r, n, similarity, 200)
            sketch = minhash.sketches(values, bounds)
            share = (sketch[::2] == sketch[1::2]).mean(1)
            assert abs(share.mean() - true) < 0.02
            assert share.std() < 1.15 * np.sqrt(true * (1 - true) / minhash.SIZE)


def test_no_pair_at_the_threshold_lacks_a_common_band():
    r = np.random.default_rng(3)
    for n in (9, 18, 45, 90, 450):
        values, bounds, true = pairs(r, n, 0.8, 2000)
        assert true >= 0.79
        sig, of = minhash.bands(values, bounds)
        sides = [set(zip((of[of % 2 == k] // 2).tolist(), sig[of % 2 == k].tolist())) for k in (0, 1)]
        assert len({k for k, _ in sides[0] & sides[1]}) == 2000


def test_repeated_rows_null_ids_and_empty_tables(spark):
    assert minhash.classes(frame(spark, [])).count() == 0
    data = [(None, "a b c d e f", *[None] * 7), (7, "a b c d e f", *[None] * 7), (7, "A b c d e f", *[None] * 7), (None, None, *[None] * 7), (9, "", *[None] * 7)]
    got = sorted((tuple(r) for r in minhash.classes(frame(spark, data)).collect()), key=repr)
    assert got == sorted([(None, 3, 7, False), (7, 3, 7, True), (7, 3, 7, True), (None, 0, None, True), (9, 0, 9, True)], key=repr)
    assert minhash.keep_first(frame(spark, data)).count() == 3


def test_keep_first_keeps_one_of_each_class(spark):
    docs = frame(spark)
    heads = sorted(k for k, v in brute(rows()).items() if v[2])
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == heads
