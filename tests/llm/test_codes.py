"""Vector codes against brute force in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from quernstone.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, cell int"


def closest(part, book):
    dist = [sum((a - b) ** 2 for a, b in zip(part, entry)) for entry in book]
    return dist.index(min(dist)), min(dist)


def brute(data, dim, entries=256, rounds=4):
    rows = [r for r in data if r[1] is not None and len(r[1]) == dim and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    whole = []
    for r in rows:
        ratios = [float(np.float32(x)).as_integer_ratio() for x in r[1]]
        whole.append([n * 1024 // d for n, d in ratios] + [0] * (-dim % 4))
    width = (dim + 3) // 4
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in whole[:entries]] for p in range(4)]
    for _ in range(rounds):
        for p in range(4):
            held = {}
            for v in whole:
                held.setdefault(closest(cut(v, p), books[p])[0], []).append(cut(v, p))
            books[p] = [[sum(x) // len(held[e]) for x in zip(*held[e])] if e in held else b for e, b in enumerate(books[p])]
    final = [[closest(cut(v, p), books[p]) for p in range(4)] for v in whole]
    error = [sum(d for _, d in f) for f in final]
    by = {}
    for r, e in zip(rows, error):
        by[r[2]] = by.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    small = lambda x: x if x < 1 << 63 else None
    wide = {r[2] for r, e in zip(rows, error) if small(e) is None}
    out = [(r[0], r[2], "".join(f"{i:02x}" for i, _ in f), small(e), None if r[2] in wide else small(by[r[2]]), sha) for r, f, e in zip(rows, final, error)]
    return sorted(out, key=repr)


def vectors(seed=1, n=90, dim=8, scale=1.0):
    r = np.random.default_rng(seed)
    out = [(i, r.normal(0, scale, dim).astype(np.float32).tolist(), (None, 0, 1, 7)[i % 4] if i % 3 else 7, "clash", 1) for i in range(n)]
    copy = out[2][1]
    out += [(500 + i, copy, 7, "clash", 1) for i in range(12)] + [(7, copy, 1, "same id", 1), (7, copy, 1, "same row", 1), (None, copy, 2, "no id", 1), (None, out[3][1], None, "no id", 1)]
    out += [(1, None, 1, "", 1), (2, [None] + copy[1:], 1, "", 1), (-5, [float("nan")] + copy[1:], 1, "", 1), (-4, [float("-inf")] + copy[1:], 1, "", 1), (-3, copy + [1.0], 1, "", 1), (-2, [], 1, "", 1)]
    return out + [(600, [0.0] * dim, 0, "", 1), (601, [-0.0] * dim, 0, "", 1)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("dim, entries, scale", [(8, 16, 0.1), (8, 256, 1.0), (6, 9, 30.0), (4, 5, 0.002), (1, 4, 1.0)])
def test_codes_equal_brute_force(spark, dim, entries, scale):
    data = vectors(dim, dim=dim, scale=scale)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    assert got(codes.compress(df, entries=entries)) == brute(data, dim, entries)


def test_huge_components_are_exact_and_errors_beyond_a_long_are_null(spark):
    data = vectors(3, 30) + [(40 + i, [x * 10.0 ** (5 + 3 * i) for x in vectors(4, 9)[0][1]], i % 3, "", 1) for i in range(11)]
    assert any(r[3] is None for r in brute(data, 8, 7)) and all(math.isfinite(x) for r in data[-11:] for x in r[1])
    assert got(codes.compress(spark.createDataFrame(data, SCHEMA), entries=7)) == brute(data, 8, 7)


def test_tables_without_usable_vectors_give_no_rows(spark):
    assert codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, 1, "", 1), (2, [None], 1, "", 1)], SCHEMA)).count() == 0


@pytest.mark.parametrize("high", [3, 300, 2**20, 2**27, 10**9, 10**25, 10**60, 10**200])
@pytest.mark.parametrize("width", [1, 5, 16])
def test_screening_never_loses_the_nearest_entry(high, width):
    r = np.random.default_rng(width)
    draw = lambda n: np.array([[int((r.random() - 0.5) * high) for _ in range(width)] for _ in range(n)], object)
    x, c = draw(40), draw(50)
    c[20:25], x[5], c[30] = c[3], c[3], c[31]
    x[6:12] = c[40:46] + np.array([r.integers(-1, 2, width).tolist() for _ in range(6)], object)
    if high < 2**26:
        x, c = x.astype(np.int64), c.astype(np.int64)
    index, dist = codes.nearest(x, c)
    assert list(zip(index.tolist(), map(int, dist))) == [closest(a.tolist(), c.tolist()) for a in x]


def test_entries_that_float32_cannot_tell_apart_are_compared_exactly():
    c = np.array([[1 << 25, 1], [(1 << 25) + 1, 1], [(1 << 25) + 2, 1]], np.int64)
    x = np.array([[(1 << 25) + 1, 5], [(1 << 25) + 2, -7], [(1 << 25) - 3, 0]], np.int64)
    assert codes._screen(x, c).all()
    assert codes.nearest(x, c)[0].tolist() == [1, 2, 0]
