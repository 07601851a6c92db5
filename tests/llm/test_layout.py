"""Mixing, sharding, records, URL filters and the pipeline."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import mixing, records, sharding, urls

from .texts import frame, rows, sentence

public_tokenizers = pytest.importorskip("public_tokenizers")


def filled(sizes, share=1.5, most=2.0):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        part = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if part[s] >= most * sizes[s]}
        if not over:
            return out | part
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_its_targets(spark, seed):
    data = rows(seed)
    got = mixing.plan(frame(spark, data)).collect()
    assert len(got) == len(data)
    sizes, taken, target, largest = collections.Counter(), collections.Counter(), {}, collections.Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 2
    want = filled(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= largest[s]
    again = {(r["doc_id"], r["copies"]) for r in mixing.plan(frame(spark, data).repartition(7)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}


def test_mix_keeps_columns_and_copies(spark):
    docs = frame(spark)
    often = {r["doc_id"]: r["copies"] for r in mixing.plan(docs).collect() if r["copies"]}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in out.collect()) == often


def test_mix_sizes_and_empty_tables(spark):
    data = [(1, "a b\tc", None, "s", 0, "", 0, "", 0), (2, None, None, None, 0, "", 0, "", 0), (3, "", None, "s", 0, "", 0, "", 0), (4, " x", None, "s", 0, "", 0, "", 0)]
    assert {r["doc_id"]: r["size"] for r in mixing.plan(frame(spark, data)).collect()} == {1: 3, 2: 0, 3: 0, 4: 1}
    assert mixing.plan(frame(spark, [])).count() == 0 and mixing.mix(frame(spark, [])).count() == 0


def test_heavier_documents_come_first(spark):
    r = random.Random(1)
    data = [(i, sentence(r, 20), None, ("a", "b", "c")[i % 3], 0, "", 0, "", 0) for i in range(900)]
    out = mixing.plan(frame(spark, data), weight=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1)).filter("source = 'c'").collect()
    often = {k: np.mean([x["copies"] for x in out if x["doc_id"] % 2 == k]) for k in (0, 1)}
    assert often[0] > often[1]


def test_keys_of_light_documents_have_no_ties(spark):
    data = [(i, "a b c d e f g h i j", None, ("a", "b", "c")[min(i % 40, 2)], 0, "", 0, "", 0) for i in range(4000)]
    out = mixing.plan(frame(spark, data), weight=F.lit(0.05)).filter("source = 'c'").collect()
    least = min(x["copies"] for x in out)
    left = [x["doc_id"] for x in out if x["copies"] == least]
    assert len({x["row_key"] for x in out}) == len(out) and 20 < len(left) < len(out) - 20
    middle = np.median([x["doc_id"] for x in out])
    assert 0.3 < np.mean([i < middle for i in left]) < 0.7


def test_mix_is_the_efraimidis_spirakis_prefix(spark):
    data = [(i, f"w{i} " + "x " * (i % 7), None, "abc"[min(i % 9, 2)], 0, "", 0, "", 0) for i in range(600)]
    got = mixing.plan(frame(spark, data), weight=F.col("doc_id") % 3 + 0.5).collect()
    for source in "abc":
        own = [x for x in got if x["source"] == source]
        epochs = int(own[0]["target"] // own[0]["source_size"])
        rest = own[0]["target"] - epochs * own[0]["source_size"]
        key = {x["doc_id"]: -np.log((int(x["row_key"][:13], 16) + 0.5) / 2**52) / (x["doc_id"] % 3 + 0.5) for x in own}
        upto = 0
        for x in sorted(own, key=lambda x: key[x["doc_id"]]):
            upto += x["size"]
            assert x["copies"] == epochs + (upto - x["size"] / 2 <= rest)


def test_mix_of_null_and_repeated_ids_keeps_rows_apart(spark):
    data = [(None, f"text {i} " + "x " * 5, None, "a", 0, "", 0, "", 0) for i in range(100)] + [(7, f"other {i} " + "y " * 5, None, None, 0, "", 0, "", 0) for i in range(300)]
    data += [(8, "same row", None, "c", 0, "", 0, "", 0)] * 3
    plan = {x["row_key"]: x["copies"] for x in mixing.plan(frame(spark, data)).collect()}
    assert len(plan) == 401
    out = collections.Counter(x["text"] for x in mixing.mix(frame(spark, data)).collect())
    assert sum(out.values()) == sum(plan.values()) + 2 * out["same row"] // 3
    assert len({out[f"other {i} " + "y " * 5] for i in range(300)}) == 2


def slot_law(got, data, shards):
    """Rows are whole, slots gapless, sizes and checksums right; the bytes of each shard."""
    size, slots, rows_ = collections.Counter(), collections.defaultdict(list), collections.Counter()
    for x in got:
        size[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
        rows_[x["doc_id"], x["size"], x["text_crc32"]] += 1
    assert rows_ == collections.Counter((d[0], len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in data)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return size


def test_shards_of_hot_groups_with_null_and_repeated_ids(spark):
    r = random.Random(8)
    for doc_id in (None, 5):
        data = [(doc_id, "same text " * 15, *[None] * 7)] * 400 + [(i, sentence(r, 20), *[None] * 7) for i in range(100)]
        size = slot_law(sharding.assign(frame(spark, data), 8).collect(), data, 8)
        assert len(size) == 8 and max(size.values()) <= 1.25 * min(size.values())


def test_whole_rows_keep_clashing_columns(spark):
    docs = frame(spark).withColumn("shard", F.lit("clash")).withColumn("slot", F.lit("clash"))
    out = sharding.assign(docs, 8, whole=True)
    assert out.columns == [*docs.columns, "size_", "text_crc32", "shard_", "slot_"]
    assert collections.Counter(map(tuple, out.select(docs.columns).collect())) == collections.Counter(map(tuple, docs.collect()))
    plain = {(x["doc_id"], x["shard"], x["slot"]) for x in sharding.assign(docs, 8).collect()}
    assert {(x["doc_id"], x["shard_"], x["slot_"]) for x in out.collect()} == plain


def test_placement_equals_brute_force():
    r = np.random.default_rng(1)
    need = np.concatenate([r.exponential(0.02, (300, 3)), r.exponential(0.3, (20, 3))])
    need *= 5 / need.sum(0)
    left = np.ones((5, 3))
    got = sharding.place(need, left)
    free = [[1.0, 1.0, 1.0] for _ in range(5)]
    for i in sorted(range(len(need)), key=lambda i: -max(v * w**0.5 for v, w in zip(need[i], sharding.WEIGHTS))):
        dots = [sum(f * v * w for f, v, w in zip(free[s], need[i], sharding.WEIGHTS)) for s in range(5)]
        assert dots[got[i]] >= max(dots) - 1e-9
        free[got[i]] = [f - v for f, v in zip(free[got[i]], need[i])]
    assert np.allclose(left, free)


def test_many_groups_are_packed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 100)
    r = random.Random(5)
    data = [(i, sentence(r, r.randint(1, 60)), *[None] * 7) for i in range(1500)]
    got = sharding.assign(frame(spark, data), 4).collect()
    size, count = slot_law(got, data, 4), collections.Counter(x["shard"] for x in got)
    assert max(size.values()) <= 1.02 * min(size.values()) and max(count.values()) <= 1.05 * min(count.values())


def test_shards_balance_bytes_and_keep_copies_together(spark):
    r = random.Random(3)
    data = [(i, sentence(r, r.randint(5, 200)), *[None] * 7) for i in range(1200)]
    data += [(5000 + i, data[5][1], *[None] * 7) for i in range(8)] + [(9000, None, *[None] * 7), (9001, "", *[None] * 7)]
    got = sharding.assign(frame(spark, data), 8).collect()
    size, slots, of = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for x in got:
        text = data[[d[0] for d in data].index(x["doc_id"])][1] or ""
        assert x["size"] == len(text.encode()) + 16 and x["text_crc32"] == zlib.crc32(text.encode())
        size[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
        of[text].add(x["shard"])
    assert len(got) == len(data) and len(size) == 8
    assert max(size.values()) <= 1.02 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of.values())


def test_a_hot_group_is_split_over_shards(spark):
    data = [(i, "same text " * 20 if i % 3 else f"other {i} " * 25, *[None] * 7) for i in range(900)]
    size = collections.Counter()
    for x in sharding.assign(frame(spark, data), 8).collect():
        size[x["shard"]] += x["size"]
    assert len(size) == 8 and max(size.values()) <= 1.1 * min(size.values())


def test_shards_of_an_empty_table(spark):
    assert sharding.assign(frame(spark, []), 8).count() == 0


def test_records_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [None, "", " ", "a  b", " lead", "trail ", "tab\t x", "Don't stop. It's 12,000 now!\n\nNew", "naïve Straße 漢字 😀 x y", "<|endoftext|> in text", "x<|endoftext|>y <|endoftext|>", "a b c", "x \n y", sentence(random.Random(1), 5000), "a b", "a b"]
    data = [(i * 3, t, *[None] * 7) for i, t in enumerate(texts)] + [(None, "null id", *[None] * 7), (0, "again", *[None] * 7)]
    where = str(tmp_path / "out")
    records.write(frame(spark, data), where, path, file_bytes=2000)
    got = records.starts(records.index(spark, where)).orderBy("start").collect()
    encoder = Tokenizer.from_file(path)
    ids = {i: encoder.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in data if i not in (0, None)}
    assert len(got) == len(data) and got[0]["doc_id"] is None
    assert [r["doc_id"] for r in got[1:]] == sorted(d[0] for d in data if d[0] is not None)
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        if r["doc_id"] in ids:
            assert r["n_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]], "<u4").tobytes())
    back = {r["doc_id"]: r["ids"] for r in records.read(spark, where, spark.read.parquet(f"{where}/index").filter("doc_id % 6 = 0 AND doc_id > 0")).collect()}
    assert back == {i: x for i, x in ids.items() if i % 6 == 0}


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, encoder = Tokenizer.from_file(path), records.Encoder(open(path).read())
    r = random.Random(4)
    pieces = ["Straße", "it's", "12,000", "<|endoftext|>", "漢字", "a", "I'll", "--", "\n", "😀", "e\u0301", "x<|endoftext|>", "''", "\u00a0", "end."]
    for k in range(3000):
        text = " ".join(r.choices(pieces, k=r.randint(1, 12)))
        assert np.frombuffer(encoder(text), encoder.kind).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_encoder_with_full_caches_equals_the_library(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(records, "CACHE", 7)
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, encoder = Tokenizer.from_file(path), records.Encoder(open(path).read())
    r = random.Random(6)
    for k in range(300):
        text = "\n".join(" ".join(w + r.choice(["", "", ".", ",", "!?"]) for w in sentence(r, 30).split()) for _ in range(3))
        assert np.frombuffer(encoder(text), encoder.kind).tolist() == whole.encode(text, add_special_tokens=False).ids, text
        assert max(map(len, (encoder.known, encoder.first, *encoder.older.values()))) <= 7


def test_records_of_a_hot_doc_id_fill_several_files(spark, tmp_path):
    r = random.Random(2)
    for doc_id in (None, 3):
        data = [(doc_id, sentence(r, 60), *[None] * 7) for _ in range(300)] + [(i, "x y", *[None] * 7) for i in (1, 9)]
        where = str(tmp_path / f"hot{doc_id}")
        records.write(frame(spark, data), where, public_tokenizers.path("byte_bpe_50k.json"), file_bytes=20_000)
        got = records.starts(records.index(spark, where)).orderBy("start").collect()
        assert len(got) == 302 and len({x["file"] for x in got if x["doc_id"] == doc_id}) > 2
        ids = [x["doc_id"] for x in got]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
        assert [x["start"] for x in got] == [0, *np.cumsum([x["n_tokens"] for x in got])[:-1].tolist()]


def test_damaged_records_are_noticed():
    good = records.frame(7, np.array([1, 2, 3], "<u2").tobytes(), False)
    doc, ids, after = records.parse(memoryview(good), 0)
    assert (doc, ids.tolist(), after) == (7, [1, 2, 3], len(good))
    for i in range(len(good) - 1):
        bad = bytearray(good)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            records.parse(memoryview(bytes(bad)), 0)


def test_records_of_an_empty_table(spark, tmp_path):
    records.write(frame(spark, []), str(tmp_path / "none"), public_tokenizers.path("byte_bpe_50k.json"))
    assert records.starts(records.index(spark, str(tmp_path / "none"))).count() == 0


PAGES = [
    (1, "https://a.com/x?y#z", ""),
    (2, "http://WWW.Example.com/en/1", ""),
    (3, "http://m.example.com/en/1", ""),
    (4, "http://example.com/de/1", ""),
    (5, "http://b.net/es/", '<a href="http://c.org/q">x</a>'),
    (6, "http://b.net/en/", ""),
    (7, "http://c.org/", '<a href="//a.com/1"><a href=\'http://b.net/es/2\'><A HREF=HTTP://D.org>'),
    (8, "http://d.org", '<a href="/local">'),
    (9, "http://e.org/", '<a class="k" href="http://a.com">'),
    (10, None, None),
    (11, "no scheme", "<a href='http://a.com'>"),
    (12, "https://a.com", None),
    (12, "https://a.com", None),
    (13, "http://a.net/fr/?http://x.com/", '<a href="http://f.org/">'),
    (14, "http://f.org/1", '<a href="http://b.net/es/">'),
    (15, "http://notcom/", ""),
]


def test_rules_hosts_and_paths(spark):
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"]) == ("a.com", "/x", "com/")
    assert (got[2]["rule"], got[2]["verdict"]) == ("www.example.com/en/", "allow")
    assert (got[3]["rule"], got[3]["verdict"]) == ("example.com/en/", "block")
    assert (got[4]["rule"], got[5]["rule"], got[6]["rule"]) == ("com/", "net/es/", None)
    assert (got[10]["host"], got[10]["path"], got[11]["host"], got[11]["verdict"]) == ("", "", "", "allow")
    assert (got[12]["path"], got[12]["rule"]) == ("", None) and got[15]["rule"] is None
    assert (got[13]["host"], got[13]["path"], got[13]["rule"]) == ("a.net", "/fr/", "net/fr/")


def test_ranks_equal_power_iteration(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    edges = {("b.net", "c.org"): 1, ("c.org", "a.com"): 1, ("c.org", "b.net"): 1, ("c.org", "d.org"): 1, ("e.org", "a.com"): 1, ("a.net", "f.org"): 1, ("f.org", "b.net"): 1}
    assert {(r["src"], r["dst"]): r["n"] for r in urls.host_edges(pages.withColumn("host", urls.host_of(F.col("url")))).collect()} == edges
    hosts = sorted({h for e in edges for h in e} | {"www.example.com", "m.example.com", "example.com"})
    seeds = {"trust": {"a.com": 1 / 3, "www.example.com": 1 / 3, "example.com": 1 / 3}, "distrust": {"m.example.com": 1 / 3, "b.net": 1 / 3, "a.net": 1 / 3}}
    want = {}
    for kind in seeds:
        links = edges if kind == "trust" else {(b, a): n for (a, b), n in edges.items()}
        out = collections.Counter()
        for (a, _), n in links.items():
            out[a] += n
        base = {h: 0.15 * seeds[kind].get(h, 0) for h in hosts}
        rank = dict(base)
        for _ in range(200):
            step = dict(base)
            for (a, b), n in links.items():
                step[b] += 0.85 * rank[a] * n / out[a]
            rank = step
        want[kind] = rank
    got = {r["host"]: r for r in urls.judge(pages).collect()}
    for h in hosts:
        if h in got:
            assert got[h]["trust"] == pytest.approx(want["trust"][h], rel=1e-8) and got[h]["distrust"] == pytest.approx(want["distrust"][h], rel=1e-8)
    assert got["f.org"]["verdict"] == "block" and got["e.org"]["verdict"] == "allow"


def test_settled_ranks_reach_hosts_far_from_a_seed(spark):
    pages = [(0, "http://h0.net/es/x", "")] + [(i, f"http://h{i}.org/", f'<a href="http://h{i - 1}.{"org" if i > 1 else "net"}/">x</a>') for i in range(1, 16)]
    pages += [(20, "http://p.org/", '<a href="http://q.org/">x</a>'), (21, "http://q.org/", '<a href="http://p.org/">x</a><a href="http://a.com/">x</a>'), (22, "http://a.com/", '<a href="http://p.org/">x</a>')]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(16):
        assert got[i]["verdict"] == "block" and got[i]["distrust"] == pytest.approx(0.15 * 0.85**i)
    p = 0.15 * 0.85 / (1 - 0.85**2 / 2 - 0.85**3 / 2)
    assert got[20]["trust"] == pytest.approx(p) and got[21]["trust"] == pytest.approx(0.85 * p) and got[20]["distrust"] == 0


def test_urls_of_an_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("seed", ["m1", "m2", "m3", "m4"])
def test_a_budget_that_ends_among_equal_rows_takes_a_part_of_them(spark, seed):
    words = lambda n: " ".join(f"w{k}" for k in range(n))
    data = [(1, words(10), None, "a", k % 3, "", 1, "", 1) for k in range(300)]
    data += [(1000 + i, words(10) + f" {i}", None, "a", 0, "", 1, "", 1) for i in range(20)] + [(2000 + i, words(30), None, "b", 0, "", 1, "", 1) for i in range(60)]
    docs = frame(spark, data)
    got = mixing.plan(docs, seed).collect()
    assert len(got) == len(data)
    for source in "ab":
        rows_ = [r for r in got if r["source"] == source]
        assert abs(sum(r["size"] * r["copies"] for r in rows_) - rows_[0]["target"]) <= 30
        assert max(r["copies"] for r in rows_ if r["doc_id"] == 1 or source == "b") <= 2
    equal = collections.Counter(r["copies"] for r in got if r["doc_id"] == 1)
    assert sum(equal.values()) == 300 and max(equal) - min(equal) <= 1
    mixed = collections.Counter(r["doc_id"] for r in mixing.mix(docs, seed).collect())
    want = collections.Counter()
    for r in got:
        want[r["doc_id"]] += r["copies"]
    assert mixed == +want


def test_the_boundary_falls_inside_a_tie_for_some_seed(spark):
    data = [(1, "a b c d", None, "a", 0, "", 1, "", 1)] * 101 + [(2, "e", None, "b", 0, "", 1, "", 1)] * 7
    got = collections.Counter((r["doc_id"], r["copies"]) for r in mixing.plan(frame(spark, data)).collect())
    # a: 404 words, b: 7; shares of 616.5 words are capped at 808 for a and 14 for b, so b is taken twice and a 602.5 words: 151 rows of 4.
    assert got == {(2, 2): 7, (1, 2): 50, (1, 1): 51}
