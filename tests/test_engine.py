"""The engine as a whole, on small filings."""

import json

import pytest
from pyspark.sql import functions as F

from quernstone.engine import Engine
from quernstone.versions import Store


def filing(words, more="net income rose "):
    return f"<DOCUMENT><TYPE>10-K\n<TEXT>\nItem 1 Business\n{words * 60}\nItem 7 Discussion\n{more * 40}\n</TEXT></DOCUMENT>"


ABOUT_PHONES = json.dumps({"triplets": [{"source": "Apple", "relation": "operates_in", "target": "Phones"}, {"source": "Apple", "relation": "competes_with", "target": "Microsoft"}]})
ABOUT_INCOME = json.dumps({"triplets": [{"source": "Apple", "relation": "reported_metric", "target": {"name": "Net Income", "value": "99.8", "unit": "billion USD", "year": "2024"}}]})


def model(text):
    return F.when(text.contains("phones"), F.lit(ABOUT_PHONES)).when(text.contains("income"), F.lit(ABOUT_INCOME)).otherwise(F.lit("{}"))


def counted(path):
    """The model, which writes down each text that it is asked about."""

    @F.udf("string")
    def note(text):
        with open(path, "a") as f:
            f.write(text[:40].replace("\n", " ") + "\n")
        return text

    return lambda text: model(note(text))


def place(tmp_path, ticker, text):
    (tmp_path / ticker).mkdir(exist_ok=True)
    (tmp_path / ticker / "full.txt").write_text(text)
    return str(tmp_path / ticker)


def embed(text):
    return F.array(*(F.size(F.split(text, w)).cast("double") for w in ("phones", "software", "income")))


def state(engine):
    return {t: sorted(map(str, engine.store.read(t).collect())) for t in ("chunks", "edges", "nodes", "asked", "vectors")}


def test_ingest_query_and_purge(spark, tmp_path, monkeypatch):
    place(tmp_path, "AAPL", filing("we sell phones "))
    place(tmp_path, "MSFT", filing("we sell software ", "it went well "))
    (tmp_path / "c.json").write_text(json.dumps({"companies": ["AAPL", "MSFT"], "default_years": [2024]}))
    engine = Engine(spark, str(tmp_path / "home"), extractor=model, embedder=embed)
    assert engine.ingest_all(str(tmp_path / "c.json"), lambda t, y: str(tmp_path / t)).count() == 0
    assert engine.chunks.groupBy("company_ticker").count().count() == 2 and engine.edges.count() == 3
    assert engine.store.read("asked").count() == engine.store.read("vectors").count() == engine.chunks.count()
    out = engine.query(["What phones does Apple sell in 2024?", "software of MSFT", "What was the net income of AAPL in 2024?"])
    ranked = out["ranked"].join(engine.chunks, "chunk_id").collect()
    assert {(r["query_id"], r["company_ticker"]) for r in ranked} >= {(0, "AAPL"), (1, "MSFT"), (2, "AAPL")} and all(r["score"] >= 0.2 for r in ranked)
    assert {r["fact"] for r in out["facts"].collect()} >= {"AAPL --OPERATES_IN--> Phones", "AAPL --COMPETES_WITH--> MSFT"}
    assert out["tickers"].filter("query_id = 0").head()["years"] == [2024]
    metric = out["metrics"].filter("query_id = 2").head()
    assert (metric["metric_id"], metric["name"], metric["value"], metric["unit"]) == ("AAPL_2024_net_income", "Net Income", "99.8", "billion USD")
    assert "| AAPL | 2024 | Net Income | 99.8 billion USD |" in out["metrics_table"].filter("query_id = 2").head()["block"]
    assert out["metrics_table"].filter("query_id = 0").count() == 0
    cited = out["citations"].filter("query_id = 2").collect()
    assert metric["chunk_id"] in {r["chunk_id"] for r in cited}
    assert {r["label"] for r in engine.nodes().filter("name = 'Net Income'").collect()} == {"FinancialMetric"}
    assert engine.communities().agg(F.sum("size")).head()[0] == 4
    assert engine.store.current().of("bm25")
    # A purge that breaks off before its commit leaves all as it was; after it all is gone, and parts are collected.
    before = state(engine)
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(Store, "commit", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        engine.purge("AAPL", 2024)
    assert state(engine) == before
    engine.purge("AAPL", 2024)
    engine.embedder = None  # else the dense list has what is left
    assert engine.query(["phones"])["ranked"].count() == 0
    assert {r["company_ticker"] for r in engine.chunks.collect()} == {"MSFT"} and engine.edges.count() == 0
    assert engine.store.collect(keep=1) and engine.chunks.filter(F.col("text").contains("software")).count() == 1


def test_changed_filings_lose_old_edges_and_ask_about_new_chunks_only(spark, tmp_path):
    log = tmp_path / "asked.txt"
    engine = Engine(spark, str(tmp_path / "home"), extractor=counted(str(log)))
    folder = place(tmp_path, "AAPL", filing("we sell phones "))
    engine.ingest(folder, "AAPL", 2024)
    first = log.read_text().splitlines()
    assert len(first) == len(set(first)) == engine.chunks.count()
    engine.ingest(folder, "AAPL", 2024)
    assert log.read_text().splitlines() == first  # not even about chunks without triplets
    place(tmp_path, "AAPL", filing("we sell tables "))
    engine.ingest(folder, "AAPL", 2024)
    more = log.read_text().splitlines()[len(first) :]
    assert len(more) == 1 and "tables" in more[0]
    assert {r["rel"] for r in engine.edges.collect()} == {"REPORTED_METRIC"}
    assert engine.edges.join(engine.chunks, "chunk_id", "left_anti").count() == 0


def test_extraction_goes_on_behind_its_last_batch(spark, tmp_path, monkeypatch):
    log = tmp_path / "asked.txt"
    engine = Engine(spark, str(tmp_path / "home"), embedder=embed)
    text = "<DOCUMENT><TYPE>10-K\n<TEXT>\n" + "".join(f"Item {n} Part\n{f'words about part {n} ' * 30}\n" for n in (1, 2, 3, 5, 6)) + "</TEXT></DOCUMENT>"
    engine.ingest(place(tmp_path, "AAPL", text), "AAPL", 2024)
    n = engine.chunks.count()
    engine.extractor = counted(str(log))
    commit, made = Store.commit, []

    def broken(store, version):
        if len(made) == 3:  # the run's beginning and two batches
            raise OSError("killed")
        made.append(version)
        return commit(store, version)

    with monkeypatch.context() as m, pytest.raises(Exception):
        m.setattr(Store, "commit", broken)
        engine.extract("AAPL", 2024, batch=1)
    stored = {r["chunk_id"] for r in engine.store.read("asked").collect()}
    assert len(stored) == 2
    said = len(log.read_text().splitlines())
    engine.extract("AAPL", 2024, batch=1)
    again = log.read_text().splitlines()[said:]
    assert len(again) == n - 2 and engine.store.read("asked").count() == n
    assert not engine.store.current().notes
