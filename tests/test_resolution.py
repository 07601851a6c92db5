"""Company resolution against brute force over all names."""

import difflib
import random

from quernstone.operators import resolution as r

UNIVERSE = [("AAPL", "Apple Inc."), ("MSFT", "MICROSOFT CORP"), ("BRK.B", "BERKSHIRE HATHAWAY INC"), ("BRK-A", "Berkshire Hathaway Inc A"), ("DOW", "DOW INC."), ("T", "AT&T INC."), ("GOOG", "Alphabet Inc."), ("NOW", "ServiceNow, Inc.")]


def universe(spark, rows=UNIVERSE):
    return spark.createDataFrame(rows, "ticker string, name string")


def asked(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def close(text, rows, k=5, least=0.5):
    low = {f"{t} {n}".lower(): t for t, n in rows}
    found = difflib.get_close_matches(text, list(low), n=k, cutoff=least)
    return [(low[m], round(difflib.SequenceMatcher(None, text, m).ratio(), 3)) for m in found]


def test_names_most_like_a_text_equal_brute_force(spark):
    rnd = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "corp", "inc", "é", "holdings", "xx"]
    rows = [(f"T{i}", " ".join(rnd.choices(words, k=rnd.randint(1, 4)))) for i in range(300)] + UNIVERSE
    texts = ["alpha betta corp", "gama delta", "berkshire hathaway", "t1", "é é é", "zzzzqq", "holdings inc holdings " * 12, ""]
    got = {}
    for x in r.closest(asked(spark, texts), universe(spark, rows).repartition(3)).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["ticker"], x["score"]))
    assert got == {i: want for i, t in enumerate(texts) if t and (want := close(t, rows))}


def test_tickers_fillers_and_candidates(spark):
    texts = ["aapl", "brk b", "BRKB", "añade MSFT 2026", "Dow Jones industrial average index", "apple incorp", "add the DOW", "MSFT or GOOG", "???", None]
    got = {}
    for x in r.resolve(asked(spark, texts), universe(spark)).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["exact"], x["ticker"], x["score"]))
    exact = {0: "AAPL", 1: "BRK.B", 2: "BRK.B", 3: "MSFT", 6: "DOW"}
    assert {i: v[0][1] for i, v in got.items() if v[0][0]} == exact and all(len(got[i]) == 1 for i in exact)
    assert got[4][0] == (False, "DOW", 1.0) and got[7][:2] == [(False, "MSFT", 1.0), (False, "GOOG", 1.0)]
    assert [(t, s) for _, t, s in got[5]] == close("apple incorp", UNIVERSE) != []
    assert 8 not in got and 9 not in got


def test_the_last_confirmed_resolution_counts(spark, tmp_path):
    path = str(tmp_path / "memo")
    assert r.recorded(spark, path).count() == 0
    confirm = lambda text, ticker: r.record(spark.createDataFrame([(text, ticker)], "text string, ticker string"), path)
    confirm("The Fruit Company!", "msft")
    confirm("the fruit  company", "aapl")
    out = r.resolve(asked(spark, ["THE FRUIT COMPANY", "fruit"]), universe(spark), r.recorded(spark, path)).collect()
    assert [(x["query_id"], x["exact"], x["ticker"], x["name"]) for x in out if x["exact"]] == [(0, True, "AAPL", "Apple Inc.")]
