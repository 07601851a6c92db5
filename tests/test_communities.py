"""Modularity communities against the same order of moves in plain Python."""

import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from quernstone.operators import communities as c, graph


def gain(w, k, total, mass, resolution):
    return float(w) - float(resolution) * float(k) * float(total) / float(mass)


def value(links, loops, k, names, mass, resolution):
    inner = sum(w for (a, b), w in links.items() if names[a] == names[b]) + sum(loops.values())
    totals = Counter()
    for n, x in names.items():
        totals[x] += k[n]
    return mass * inner - Fraction(resolution) * sum(t * t for t in totals.values())


def weights(links, names):
    out = {n: Counter({names[n]: 0}) for n in names}
    for (a, b), w in links.items():
        out[a][names[b]] += w
    return out


def local_moves(links, loops, k, names, mass, resolution):
    best, any_, still, turn = value(links, loops, k, names, mass, resolution), False, 0, 0
    while still < 2 and turn < c.ROUNDS:
        turn += 1
        near, totals = weights(links, names), Counter()
        for n, x in names.items():
            totals[x] += k[n]
        wish = {}
        for n, own in names.items():
            scored = {x: gain(w, k[n], totals[x] - (k[n] if x == own else 0), mass, resolution) for x, w in near[n].items()}
            right = [(-s, x) for x, s in scored.items() if (x > own if turn % 2 == 0 else x < own)]
            if right and -min(right)[0] > scored[own]:
                wish[n] = min(right)[1]
        for half in range(c.TRIES):
            goes = {n: x for n, x in wish.items() if zlib.crc32(f"{n}|{turn}".encode()) % (1 << half) == 0}
            if not goes:
                still += 1
                break
            after = names | goes
            if (better := value(links, loops, k, after, mass, resolution)) > best:
                names, best, any_, still = after, better, True, 0
                break
        else:
            still += 1
    return names, any_


def refined(links, k, names, mass, resolution):
    inner = {(a, b): w for (a, b), w in links.items() if names[a] == names[b]}
    within, whole = Counter(), Counter()
    for (a, _), w in inner.items():
        within[a] += w
    for n, x in names.items():
        whole[x] += k[n]
    linked = {n for n in within if gain(within[n], k[n], whole[names[n]] - k[n], mass, resolution) >= 0}
    parts = {n: n for n in names}
    for _ in range(c.MERGES):
        total, size = Counter(), Counter()
        for n, x in parts.items():
            total[x] += k[n]
            size[x] += 1
        goes = {}
        for n, near in weights(inner, parts).items():
            if size[n] == 1 and n in linked:
                scored = [(-gain(w, k[n], total[x], mass, resolution), x) for x, w in near.items() if x < n and w > 0]
                scored = [s for s in scored if -s[0] > 0]
                if scored:
                    goes[n] = min(scored)[1]
        parts |= {n: x for n, x in goes.items() if x not in goes}
        if not goes:
            break
    return parts


def brute(edges, resolution=1.0):
    links = Counter()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            links[a, b] += 1
            links[b, a] += 1
    k = Counter()
    for (a, _), w in links.items():
        k[a] += w
    mass, names, at, loops = sum(k.values()), {n: n for n in k}, {n: n for n in k}, Counter()
    for _ in range(c.LEVELS):
        names, moved = local_moves(links, loops, k, names, mass, resolution)
        if not moved:
            break
        parts = refined(links, k, names, mass, resolution)
        at = {n: parts[x] for n, x in at.items()}
        merged, k2, loops2, names2 = Counter(), Counter(), Counter(), {}
        for (a, b), w in links.items():
            merged[parts[a], parts[b]] += w
        for n, p in parts.items():
            k2[p] += k[n]
            loops2[p] += loops[n]
            names2[p] = min(names2.get(p, names[n]), names[n])
        for (x, y), w in merged.items():
            if x == y:
                loops2[x] += w
        links, k, loops, names = Counter({p: w for p, w in merged.items() if p[0] != p[1]}), k2, loops2, names2
    found = {n: names[x] for n, x in at.items()}
    least = {}
    for n, x in found.items():
        least[x] = min(least.get(x, n), n)
    return {n: least[x] for n, x in found.items()}


def blocks(seed, groups=5, size=9, inside=0.6, outside=0.05):
    r = random.Random(seed)
    names = [f"n{i:03d}" for i in range(groups * size)]
    r.shuffle(names)
    return [(a, b) for i, a in enumerate(names) for j, b in enumerate(names[:i]) if r.random() < (inside if i % groups == j % groups else outside)], names, groups


def frame(spark, edges):
    return spark.createDataFrame(edges, "a string, b string")


@pytest.mark.parametrize("seed, resolution", [(1, 1.0), (3, 2.5)])
def test_communities_equal_the_same_moves_in_plain_python(spark, seed, resolution):
    edges = blocks(seed)[0] + [("n001", "n001"), (None, "n002"), ("x1", "x2"), ("x1", "x2"), ("y", "y")]
    got = {r["node"]: r["community"] for r in c.modular(frame(spark, edges), resolution).collect()}
    assert got == brute(edges, resolution)
    assert got["x1"] == got["x2"] == "x1" and "y" not in got


def test_planted_groups_are_found_and_beat_components_and_labels(spark):
    edges, names, groups = blocks(7, inside=0.8, outside=0.03)
    df = frame(spark, edges)
    found = c.modular(df).cache()
    got = {r["node"]: r["community"] for r in found.collect()}
    planted = defaultdict(set)
    for i, n in enumerate(names):
        planted[i % groups].add(n)
    by = defaultdict(set)
    for n, x in got.items():
        by[x].add(n)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, planted.values()))
    inner = frame(spark, [(a, b) for a, b in edges if got[a] == got[b]])
    assert {r["node"]: r["component"] for r in graph.connected(inner).collect()}.items() <= got.items()
    best = c.modularity(df, found)
    assert best > 0.5
    assert best >= c.modularity(df, graph.connected(df).withColumnRenamed("component", "community"))
    assert best >= c.modularity(df, graph.propagate_labels(df))


def test_modularity_of_known_divisions_and_no_edges(spark):
    edges = [(a, b) for t in ("abc", "def") for i, a in enumerate(t) for b in t[:i]] + [("a", "d")]
    df = frame(spark, edges)
    halves = spark.createDataFrame([(x, x in "abc") for x in "abcdef"], "node string, community boolean")
    assert abs(c.modularity(df, halves) - (6 / 7 - 0.5)) < 1e-12
    assert abs(c.modularity(df, halves.selectExpr("node", "1 AS community"))) < 1e-12
    assert c.modular(frame(spark, [])).count() == 0 and c.modularity(frame(spark, []), halves) == 0.0

def brute_groups(rows):
    """The edges that groups stand for, both ways."""
    return [(x, y) for g, x, n in rows for h, y, m in rows if g == h and x != y for _ in range(n * m)]


@pytest.mark.parametrize("seed, resolution", [(1, 1.0), (2, 1.7)])
def test_groups_give_the_communities_of_their_pairs(spark, seed, resolution):
    r = random.Random(seed)
    edges = blocks(seed, groups=4, size=8, inside=0.25)[0] + [("n001", "m1"), ("n002", "m1"), ("n003", "m2")]
    rows = {(r.randrange(4), f"n{i:03d}"): r.choice((1, 1, 2)) for i in [*range(26), *range(26), 40, 41]} | {(9, "alone"): 2}
    rows = [(g, x, n) for (g, x), n in rows.items()]
    groups = spark.createDataFrame(rows, "group int, node string, n long")
    found = c.modular(frame(spark, edges), resolution, groups)
    got = {r["node"]: r["community"] for r in found.collect()}
    pairs = edges + brute_groups(rows)
    assert got == brute(pairs, resolution) and "alone" not in got
    assert c.modularity(frame(spark, edges), found, resolution, groups) == c.modularity(frame(spark, pairs), found, resolution)


def test_members_of_a_group_are_not_paired(spark, monkeypatch):
    made, write = {}, c.materialize

    def spy(df, name, rows=None):
        out = write(df, name, rows)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(c, "materialize", spy)
    rows = [(i % 2, f"n{i:03d}", 1) for i in range(200)]
    edges = [(f"n{i:03d}", f"m{i}") for i in range(200)]
    got = {r["node"]: r["community"] for r in c.modular(frame(spark, edges), groups=spark.createDataFrame(rows, "group int, node string, n long")).collect()}
    assert len(got) == 400 and len(set(got.values())) == 2
    assert max(made.values()) <= 3 * 400


@pytest.mark.parametrize("most, sent", [(100, False), (100_000, True)])
def test_tables_over_a_bound_are_not_broadcast(spark, monkeypatch, most, sent):
    plans, write = [], c.materialize

    def spy(df, name, rows=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, rows)

    monkeypatch.setattr(c, "materialize", spy)
    monkeypatch.setattr(c, "BROADCAST_ROWS", most)
    for limit in ("ROUNDS", "MERGES", "LEVELS"):
        monkeypatch.setattr(c, limit, 1)
    rows = [(i % 4, f"n{i:03d}", 1) for i in range(120)] + [(9, "n001", 1), (9, "n002", 1)]
    edges = [(f"n{i:03d}", f"m{i % 50}") for i in range(120)]
    groups = spark.createDataFrame(rows, "group int, node string, n long")
    got = {r["node"]: r["community"] for r in c.modular(frame(spark, edges), groups=groups).collect()}
    assert got == brute(edges + brute_groups(rows))
    # Plans of the first rounds; a later level may be below the bound.
    assert sent == any("BroadcastHashJoin" in p for p in plans[2:8])
