"""Language identification by nearest centroid.

A text becomes a vector of hashed character 1- to 3-grams (letters lower-cased,
everything else one space), log term frequency times inverse document
frequency, scaled to length one.  Each language has several centroids from
spherical k-means; the prediction is the language of the centroid with the
highest cosine.  A text whose best cosine is under the rejection threshold is
marked as rejected.

The document frequencies come from every row that may be learned from.  The
centroids are fitted on a bounded sample: about ``per_language`` rows for each
language, chosen by the hash of doc_id.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quernstone.llm.kernels import codepoints, slices, texts
from quernstone.workspace import in_arrow

DIMS = 4096
BLOCK = 500_000


@lru_cache
def letters() -> np.ndarray:
    """By code point: is it a letter?  Built once in a process."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def grams(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed 1- to 3-grams, a row for each text, and whether it has a letter."""
    codes, offsets = codepoints([x.lower() + " " for x in rows])
    row = np.repeat(np.arange(len(rows)), np.diff(offsets))
    isl = letters()[codes]
    has = np.bincount(row[isl], minlength=len(rows)) > 0
    keep = isl.copy()
    keep[1:] |= isl[:-1]  # one space after each run of letters
    s, row = np.where(isl, codes, 32).astype(np.uint32)[keep], row[keep]
    base = row * DIMS
    a, b, c = s * np.uint32(2654435761), s * np.uint32(2246822519), s * np.uint32(3266489917)
    two, three = a[:-1] ^ (b[1:] + np.uint32(0x165667B1)), a[:-2] ^ (b[1:-1] + np.uint32(0x27D4EB2F)) ^ (c[2:] >> 1)
    at = [base + (a >> 20)]
    for n, h in ((1, two), (2, three)):
        same = row[n:] == row[: len(row) - n]
        h = h * np.uint32(0x9E3779B1)
        at.append(base[n:][same] + ((h ^ (h >> 15)) >> 20)[same])
    counts = np.zeros(len(rows) * DIMS, np.float32)
    if len(s):
        counts = np.bincount(np.concatenate(at), minlength=len(rows) * DIMS).astype(np.float32)
    return counts.reshape(len(rows), DIMS), has


def cut(rows: list[str], most: int = BLOCK, wide: int = 128) -> Iterator[slice]:
    """Slices of at most ``wide`` rows and about ``most`` characters."""
    i = size = 0
    for j, x in enumerate(rows):
        if j > i and (size + len(x) > most or j - i >= wide):
            yield slice(i, j)
            i, size = j, 0
        size += len(x)
    if i < len(rows):
        yield slice(i, len(rows))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        n += batch.num_rows
        for part in slices(batch, 0, BLOCK, 128):
            total += (grams(texts(part.column(0)))[0] > 0).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.concatenate([[n], total]))], ["dim", "df"])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 0, BLOCK, 128):
            x, _ = grams(texts(part.column(0)))
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([v.tobytes() for v in x], pa.binary()), part.column(2)], ["lang", "v", "n"])


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def centroids(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7, often: np.ndarray | None = None) -> np.ndarray:
    """Spherical k-means of rows that count ``often``; the first centres are spread out by farthest choice."""
    often = np.ones(len(x)) if often is None else often
    pick = [int(np.random.default_rng(seed).integers(len(x)))]
    while len(pick) < min(k, len(x)):
        pick.append(int(np.argmin((x @ x[pick].T).max(1))))
    centre = x[pick]
    for _ in range(rounds):
        near = (x @ centre.T).argmax(1)
        sums = np.stack([often[near == i] @ x[near == i] if (near == i).any() else centre[i] for i in range(len(centre))])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centre


def fit(learn: DataFrame, per_language: int = 300, clusters: int = 4) -> dict:
    """The model from ``learn(doc_id, text, lang)``; rows without a lang teach nothing.

    Repeated rows count each; null and empty texts count as texts without a
    gram; a very long text is read as a whole.  Of a language's sample equal texts
    are one vector that weighs as often as they occur, and ``per_language`` vectors
    at most come to the driver, those with the smallest hashes.
    """
    learn = learn.filter("lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    if not counts:
        return {"langs": [], "idf": np.ones(DIMS, np.float32), "centres": np.zeros((0, DIMS), np.float32), "of": np.zeros(0, int)}
    unit = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id"), F.xxhash64("text")), F.lit(1 << 20)) / float(1 << 20)
    # Few rows of a language are all read, so that they can't all miss their odds.
    share = {k: 1.0 if n <= 4 * per_language else 2 * per_language / n for k, n in counts.items()}
    odds = F.element_at(F.create_map(*[y for k, part in share.items() for y in (F.lit(k), F.lit(part))]), F.col("lang"))
    sample = learn.filter(unit < odds).groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), F.count("*").alias("n"))
    sample = sample.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("place") <= per_language)
    rows = in_arrow(sample.select("text", "lang", "n"), _sample, "lang string, v binary, n long").collect()
    rows.sort(key=lambda r: (r["lang"], r["v"], r["n"]))  # whatever the order of arrival
    counted = in_arrow(learn.select("text"), _frequencies, "dim long, df long").groupBy("dim").agg(F.sum("df").alias("n"))
    df = {r["dim"]: r["n"] for r in counted.collect()}
    n = df.pop(-1)
    idf = np.log((1 + n) / (1 + np.array([df[i] for i in range(DIMS)], float))).astype(np.float32) + np.float32(1)
    x = weigh(np.stack([np.frombuffer(r["v"], np.float32) for r in rows]), idf)
    of, often = np.array([r["lang"] for r in rows]), np.array([r["n"] for r in rows], np.float32)
    langs = sorted(set(of))
    found = [centroids(x[of == lang], clusters, often=often[of == lang]) for lang in langs]
    of_centre = np.repeat(np.arange(len(langs)), [len(f) for f in found])
    return {"langs": langs, "idf": idf, "centres": np.concatenate(found).astype(np.float32), "of": of_centre}


def predict(docs: DataFrame, model: dict, reject_below: float = 0.1, sharpness: float = 20.0) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, lang_pred, score, rejected``, a row for each row.

    ``score`` is the winner's share of ``exp(sharpness * cosine)`` over the
    languages' best cosines; ties go to the first language by name.  A null
    text, and a text without a letter, is ``und`` with score 0 and counts as
    rejected; so is everything when the model knows no language.  Repeated
    rows are judged alike, very long texts by all their grams.  Empty tables
    give no rows.
    """
    langs, idf, centres, of = model["langs"], model["idf"], model["centres"], model["of"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, BLOCK, 128):
                counts, has = grams(texts(part.column(1)))
                if langs:
                    cos = weigh(counts, idf) @ centres.T
                    best = np.stack([cos[:, of == i].max(1) for i in range(len(langs))], 1).astype(float)
                    win = best.argmax(1)
                    top = best[np.arange(len(best)), win]
                    score = np.where(has, 1 / np.exp(sharpness * (best - top[:, None])).sum(1), 0.0)
                else:
                    has, win, top, score = np.zeros(len(has), bool), np.zeros(len(has), int), np.zeros(len(has)), np.zeros(len(has))
                names = [langs[w] if h else "und" for w, h in zip(win, has)]
                made = (pa.array(names, pa.string()), pa.array(score), pa.array(~has | (top < reject_below)))
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", "lang_pred", "score", "rejected"])

    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = fit(docs.filter(fold != 2))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
