"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of ``WIDTH`` characters.  Each passage is
described by the shares of its character classes, of their transitions and of
repeated words, and by the shares of its words in ``WORDS`` hashed cells.  A
learned layer encodes it, and gated attention
``softmax(w . (tanh(V h) * sigmoid(U h)))`` weighs it; the weighted sum is scored
by a logistic layer.  Only document labels are used.

The network is trained on the driver on a bounded sample: about ``per_class``
labelled documents of each label, chosen by the hash of doc_id, with at most
``per_bag`` passages of each, spread evenly over the text, weighted back to the
labels' true shares.  Scoring covers every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quernstone.llm.kernels import codepoints, mix, slices, texts
from quernstone.llm.language import letters
from quernstone.workspace import in_arrow

WIDTH = 400
#: One class for each of these characters, besides those of ``_classes``.
MARKS = "!$%&#*|@<>{}[]()/\\_-:;\"'=+~^`?"
SMALL = 9
CLASSES = SMALL + len(MARKS)
#: Cells that words are hashed into.
WORDS = 128
FEATURES = CLASSES + SMALL * SMALL + 3 + WORDS


@lru_cache
def _classes() -> np.ndarray:
    """By code point: 0 other, 1 a-z, 2 A-Z, 3 other letter, 4 digit, 5 blank, 6 line break, 7 full stop or comma, 8 other ASCII mark, 9.. MARKS."""
    out = np.zeros(0x110000, np.uint8)
    out[letters()] = 3
    out[97:123], out[65:91], out[48:58] = 1, 2, 4
    out[33:48][out[33:48] == 0] = 8
    out[[32, 9, 160]], out[[10, 13]], out[[46, 44]] = 5, 6, 7
    for i, c in enumerate(MARKS):
        out[ord(c)] = SMALL + i
    return out


def passages(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A feature row for each passage, and the number of passages of each text (one at least)."""
    codes, offsets = codepoints(rows)
    length = np.diff(offsets)
    count = np.maximum(-(-length // WIDTH), 1)
    first = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(len(codes)) - np.repeat(offsets[:-1], length)
    at = np.repeat(first[:-1], length) + place // WIDTH
    kind = _classes()[codes]
    n = np.maximum(np.bincount(at, minlength=first[-1]), 1)[:, None]
    one = np.bincount(at * CLASSES + kind, minlength=first[-1] * CLASSES).reshape(-1, CLASSES) / n
    small = np.where(kind >= SMALL, 8, kind)
    inner = at[1:] == at[:-1] if len(at) else np.zeros(0, bool)
    pair = (at[1:] * SMALL + small[:-1].astype(np.int64)) * SMALL + small[1:]
    two = np.bincount(pair[inner], minlength=first[-1] * SMALL * SMALL).reshape(-1, SMALL * SMALL) / n
    blank = (one[:, 5] + one[:, 6])[:, None]
    again, terms = _words(codes, (kind != 5) & (kind != 6), offsets, at, first[-1])
    described = (one, two, 1 / (blank + 0.02) / 50, np.minimum(n / WIDTH, 1), again[:, None], terms)
    return np.concatenate(described, 1).astype(np.float32), count


def _words(codes: np.ndarray, inside: np.ndarray, offsets: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each passage the share of its words that repeat the word before, and ten times the shares of its words in hashed cells.

    A word belongs to the passage it begins in; A-Z count as a-z.
    """
    start = inside.copy()
    if len(start):
        start[1:] &= ~inside[:-1]
        rows = offsets[:-1][offsets[:-1] < offsets[1:]]
        start[rows] = inside[rows]
    begin = np.flatnonzero(start)
    if not len(begin):
        return np.zeros(n), np.zeros((n, WORDS))
    lower = codes[begin[0] :].astype(np.uint64)
    lower += np.where((lower >= 65) & (lower <= 90), 33, 1).astype(np.uint64)
    place = np.arange(begin[0], len(codes)) - np.repeat(begin, np.diff(np.append(begin, len(codes))))
    lower *= place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93)
    lower[~inside[begin[0] :]] = 0
    word = mix(np.add.reduceat(lower, begin - begin[0]))
    same = np.zeros(len(word))
    same[1:] = (word[1:] == word[:-1]) & (np.searchsorted(offsets, begin[1:], "right") == np.searchsorted(offsets, begin[:-1], "right"))
    total = np.maximum(np.bincount(at[begin], minlength=n), 1)
    cells = np.bincount(at[begin] * WORDS + (word % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    return np.bincount(at[begin], same, n) / total, 10 * cells / total[:, None]


def _sample(per_bag: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                x, count = passages(texts(part.column(0)))
                bags = (b[np.unique(np.linspace(0, len(b) - 1, min(per_bag, len(b))).astype(int))] for b in np.split(x, np.cumsum(count)[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array([b.astype(np.float16).tobytes() for b in bags], pa.binary()), part.column(1).cast(pa.int32()), part.column(2)], ["bag", "y", "n"])

    return run


def forward(m: dict, x: np.ndarray, starts: np.ndarray) -> dict:
    """Scores of the bags that begin at ``starts``, with what training needs."""
    z = np.clip((x - m["mean"]) / m["std"], -8, 8)
    h = np.tanh(z @ m["E"] + m["e"])
    t, g = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    a = (t * g) @ m["w"]
    count = np.diff(np.append(starts, len(x)))
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), count))
    a /= np.repeat(np.add.reduceat(a, starts), count)
    bag = np.add.reduceat(h * a[:, None], starts)
    return {"z": z, "h": h, "t": t, "g": g, "a": a, "bag": bag, "count": count, "score": 1 / (1 + np.exp(-np.clip(bag @ m["c"] + m["b"], -60, 60)))}


def gradients(m: dict, x: np.ndarray, count: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """The gradients of the weighted mean log loss of bags of ``count`` passages each."""
    starts = np.concatenate([[0], np.cumsum(count)[:-1]])
    f = forward(m, x, starts)
    d = (f["score"] - y) * weight / weight.sum()
    dbag = np.repeat(d[:, None] * m["c"], count, axis=0)
    da = (dbag * f["h"]).sum(1)
    da = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), count))
    dt = da[:, None] * m["w"] * f["g"] * (1 - f["t"] ** 2)
    dg = da[:, None] * m["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (dbag * f["a"][:, None] + dt @ m["V"].T + dg @ m["U"].T) * (1 - f["h"] ** 2)
    return {
        "E": f["z"].T @ dh,
        "e": dh.sum(0),
        "V": f["h"].T @ dt,
        "U": f["h"].T @ dg,
        "w": (f["t"] * f["g"]).T @ da,
        "c": f["bag"].T @ d,
        "b": d.sum(keepdims=True),
    }


def initial(x: np.ndarray, hidden: int, gate: int, seed: int) -> dict:
    """The scaling of the features ``x``, and random weights.

    The cells of words, many and sparse, count a quarter of the others.
    """
    r = np.random.default_rng(seed)
    spread = np.ones(x.shape[1])
    spread[FEATURES - WORDS :] = 4
    return {
        "mean": x.mean(0),
        "std": (x.std(0) + 0.01) * spread,
        "E": r.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)),
        "e": np.zeros(hidden),
        "V": r.normal(0, hidden**-0.5, (hidden, gate)),
        "U": r.normal(0, hidden**-0.5, (hidden, gate)),
        "w": r.normal(0, gate**-0.5, gate),
        "c": r.normal(0, hidden**-0.5, hidden),
        "b": np.zeros(1),
    }


def train(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 60, batch: int = 128, rate: float = 0.01, seed: int = 11) -> dict:
    """Adam on the weighted log loss."""
    m = initial(np.concatenate(bags), hidden, gate, seed)
    names = [k for k in m if k not in ("mean", "std")]
    first, second, step = {k: np.zeros_like(m[k]) for k in names}, {k: np.zeros_like(m[k]) for k in names}, 0
    r = np.random.default_rng(seed + 1)
    for epoch in range(epochs):
        order = r.permutation(len(bags))
        for i in range(0, len(order), batch):
            take = order[i : i + batch]
            grad = gradients(m, np.concatenate([bags[k] for k in take]), np.array([len(bags[k]) for k in take]), y[take], weight[take])
            step += 1
            for k in names:
                g = grad[k] + 1e-4 * m[k]
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
                m[k] = m[k] - rate * (0.5 ** (3 * epoch / epochs)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, per_bag: int = 32) -> dict | None:
    """The model from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``.

    Null labels and labels of unknown documents teach nothing; of several
    labels of one document the highest counts, and each of its rows is a bag.
    Equal texts of a label are one bag that weighs as often as they occur, and
    beyond twice ``per_class`` such bags of a label those with the smallest hashes
    are taken.  None without labelled text.
    """
    labels = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in labels.groupBy("y").count().collect()}
    if not counts:
        return None
    unit = F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    odds = F.element_at(F.create_map(*[v for k, n in counts.items() for v in (F.lit(k), F.lit(min(1.0, per_class / n)))]), F.col("y"))
    # About per_class rows for each label: bounded, so it may be sent to all executors.
    chosen = F.broadcast(labels.filter(unit < odds))
    taught = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("y", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("y").orderBy("h"))
    taught = taught.withColumn("place", place).filter(F.col("place") <= 2 * per_class).select("text", "y", "n")
    rows = in_arrow(taught, _sample(per_bag), "bag binary, y int, n long").collect()
    if not rows:
        return None
    bags = [np.frombuffer(r["bag"], np.float16).astype(np.float32).reshape(-1, FEATURES) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["y"], rows[i]["bag"], rows[i]["n"]))  # whatever the order of arrival
    y = np.array([rows[i]["y"] for i in order], float)
    n = np.array([rows[i]["n"] for i in order], float)
    weight = n * np.array([counts[int(k)] for k in y]) / np.array([n[y == k].sum() for k in y])
    return train([bags[i] for i in order], y, weight)


def _scores(model: dict | None, part: pa.RecordBatch, text: int) -> np.ndarray:
    if model is None:
        return np.ones(part.num_rows)
    x, count = passages(texts(part.column(text)))
    return forward(model, x, np.concatenate([[0], np.cumsum(count)[:-1]]))["score"]


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, score, predicted``, a row for each row.

    A null or empty text is one empty passage; of a very long text every
    passage counts.  Repeated rows are scored alike.  Without a model every
    score is 1.  Empty tables give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                s = _scores(model, part, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep(docs: DataFrame, model: dict | None, threshold: float = 0.5, score_name: str | None = None) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns.

    With ``score_name`` the score is one more column, in place of one of that
    name.  Null and empty texts
    are judged as one empty passage, very long ones by all their passages;
    repeated rows stay or go together.  Without a model every row stays.
    """
    docs = docs if score_name is None else docs.drop(score_name)
    at = docs.columns.index("text")
    schema = docs.schema if score_name is None else docs.schema.add(score_name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                s = _scores(model, part, at)
                out = part if score_name is None else pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], schema.names)
                yield out.filter(pa.array(s >= threshold))

    return docs if model is None and score_name is None else in_arrow(docs, run, schema)


def fold(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(fold() != 1)
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted")
