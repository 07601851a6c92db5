"""The conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quernstone.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, owner string, fp int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(data):
    """Node rows by prefixes as tuples."""
    sha = lambda x: hashlib.sha256(x.encode()).digest()
    talks = defaultdict(list)
    for conv, turn, role, text, *_ in data:
        if conv is not None:
            role, text = role or "", text or ""
            talks[conv].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    talks = {c: [x[3:] for x in sorted(t)] for c, t in talks.items()}
    built = {}
    for c, t in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(talks.get(base, [])[:h] + t[h:])
    members, ended = defaultdict(list), defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
        ended[t].append(c)
    children = defaultdict(list)
    for t in members:
        if t:
            children[t[:-1]].append(t)
    leaves, saved = {}, {}
    for t in sorted(members, key=len, reverse=True):
        leaves[t] = sum(leaves[u] for u in children[t]) if children[t] else 1
        saved[t] = (len(members[t]) - 1) * len(WORD.findall(t[-1][1]) if t else []) + sum(saved[u] for u in children[t])
    return sorted(
        (min(m), len(t), min(members[t[:-1]]) if t else None, len(m), len(children[t]), leaves[t], saved[t], hashlib.sha256(",".join(map(str, sorted(ended.get(t, [])))).encode()).hexdigest())
        for t, m in members.items()
    )


def talk(r, conv, n, words=4):
    return [(conv, i, r.choice(["user", "assistant"]), " ".join(r.choices("abcdefgh", k=r.randint(0, words))), "x", 1) for i in range(n)]


def table(seed=1, convs=90, long=260):
    r = random.Random(seed)
    first = talk(r, 0, long)
    out = first + talk(r, -3, 4) + talk(r, 7_000_000_000_000_000_003, 3)
    for c in range(1, convs):
        if c % 5 == 0:  # an exact copy, or one with another end
            out += [(c, *x[1:]) for x in first[: r.choice([2, 5, 9, long])]] + ([(c, 10_000, "user", f"end {c % 3}", "x", 1)] if c % 2 else [])
        elif c % 7 != 0:
            out += talk(r, c, r.randint(1, 9), 1)
    out += [(3, None, "user", "null turn first", "x", 1), (3, None, None, None, "x", 1), (4, 0, "user", "tie", "x", 1), (4, 0, "user", "tie", "x", 1), (4, 0, "user", "another", "x", 1)]
    out += [(None, 1, "user", "of no conversation", "x", 1), (21, 5, None, "role is empty", "x", 1), (21, 6, "user", None, "x", 1), (22, 0, "user", "long " * 30_000, "x", 1)]
    r.shuffle(out)
    return out


def found(df):
    return sorted(tuple(x) for x in df.collect())


@pytest.mark.parametrize("bits", [64, 2])
def test_nodes_equal_brute_force(spark, bits):
    data = table()
    assert found(trie.trie(spark.createDataFrame(data, SCHEMA), bits)) == brute(data)


def test_collisions_are_found_and_split(spark):
    _, rows = trie.rebuilt(spark.createDataFrame(table(2, 40, 30), SCHEMA), 1)
    assert trie.groups(rows).filter("wrong").count()
    rows, nodes = trie.verified(rows)
    assert nodes.count() == len(brute(table(2, 40, 30))) - 1
    assert not trie.groups(rows).filter("wrong").count()


def test_a_chain_of_branches_takes_few_rounds_and_right_sums(spark):
    r = random.Random(5)
    data = talk(r, 0, 24)
    for c in range(1, 24):  # each leaves the one before it a turn later
        data += [(c * 20, *x[1:]) for x in data if x[0] == (c - 1) * 20 and x[1] < c] + [(c * 20, c + k, "user", f"{c} {k}", "x", 1) for k in range(4)]
    assert found(trie.trie(spark.createDataFrame(data, SCHEMA))) == brute(data)


def test_many_equal_conversations_share_their_nodes_and_their_hash(spark):
    data = [(20 * c, i, "user", f"t{i}", "x", 1) for c in range(400) for i in range(3)]
    got = trie.trie(spark.createDataFrame(data, SCHEMA))
    assert found(got) == brute(data) and got.count() == 4


def test_an_empty_table_and_one_of_turnless_conversations(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [(c, 0, "user", "hello", "x", 1) for c in range(1, 9)]
    assert found(trie.trie(spark.createDataFrame(one, SCHEMA))) == brute(one)
    assert trie.trie(spark.createDataFrame([(None, 0, "user", "x", "x", 1)], SCHEMA)).count() == 0


def test_powers_wrap_like_integers():
    e = np.array([0, 1, 2, 63, 64, 1000, 123_456_789])
    assert trie.power(e).tolist() == [pow(trie.BASE, int(k), 1 << 64) for k in e]
