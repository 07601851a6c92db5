"""MinHash near-duplicates by fast similarity sketches.

A sketch has ``SIZE`` coordinates.  Round ``i`` hashes every element of a set to a
bin and a value in [0, 1), and the bin keeps the least ``i + value``.  In the
first ``SIZE`` rounds a hash picks the bin; in as many more, round ``SIZE + b`` puts
all elements into bin ``b``.  A set is done after the first round that leaves
no bin empty, at the latest when those rounds have filled each bin, so every
coordinate is filled, in about ``SIZE * ln(SIZE)`` steps for a small set and in one
pass for a large one.  The part of coordinates at which two sketches agree has
the Jaccard similarity as its mean, and is at least as concentrated about it as
with independent hash functions.

``ROWS`` consecutive coordinates are one band, and sets that agree on a band are
candidates.  At a similarity of 0.8 a band agrees with a probability of 0.41,
so that all 40 bands fail for less than one pair in a thousand million; a pair
that is more alike fails less.  Members meet, and links are verified on whole
sets, as in the n-gram Jaccard join.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quernstone.llm import jaccard
from quernstone.llm.kernels import U64, mix

SIZE, ROWS = 160, 4
#: A coordinate is its round above ``_VALUE`` bits of a hash; the other bits of that hash pick the bin.
_VALUE = 40
_EMPTY = ~U64(0)
_SEED = 0x9E3779B97F4A7C15


def sketches(values: np.ndarray, bounds: np.ndarray, size: int = SIZE) -> np.ndarray:
    """A row of ``size`` coordinates for each set of hashes in ``values`` between ``bounds``; an empty set's are all ``2^64 - 1``."""
    n = len(bounds) - 1
    out = np.full(n * size, _EMPTY, U64)
    count = np.diff(bounds)
    owner = np.repeat(np.arange(n), count)
    for i in range(2 * size):
        if not len(owner):
            break
        hashed = mix(values ^ U64((i + 1) * _SEED & (1 << 64) - 1))
        at = ((hashed >> U64(_VALUE)) * U64(size) >> U64(64 - _VALUE)).astype(np.int64) if i < size else i - size
        np.minimum.at(out, owner * size + at, U64(i << _VALUE) | hashed & U64((1 << _VALUE) - 1))
        open_ = (out.reshape(n, size) == _EMPTY).any(1)[owner]
        values, owner = values[open_], owner[open_]
    return out.reshape(n, size)


def bands(values: np.ndarray, bounds: np.ndarray, size: int = SIZE, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """A signature for each band of each set, and the set of each; an empty set has none."""
    full = np.flatnonzero(np.diff(bounds))
    sketch = sketches(values, bounds, size)[full].reshape(len(full), size // rows, rows)
    salt = mix(np.arange(size, dtype=U64) + U64(0x632BE59BD9B4E019)).reshape(size // rows, rows)
    sums = mix(sketch ^ salt).sum(2, dtype=U64) + mix(np.arange(size // rows, dtype=U64))
    return mix(sums).reshape(-1), np.repeat(full, size // rows)


def links(docs: DataFrame, percent: int = 80, width: int = 4) -> tuple[DataFrame, DataFrame]:
    """``(profile, edges)`` of ``docs(doc_id, text)``, as ``jaccard.join`` gives them."""

    def signer(docs: DataFrame, rows: int) -> Callable:
        return bands

    return jaccard.join(docs, percent, width, lambda size: np.where(size > 0, SIZE // ROWS, 0), signer)


def classes(docs: DataFrame, percent: int = 80, width: int = 4) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row for each row of ``docs``.

    ``component_id`` is the smallest doc_id reachable by links, the row's own
    included; ``kept`` says whether that is the row's own.  Equal sets link, so
    repeated rows share a component, and rows that repeat its smallest doc_id
    are all kept.  A null text, an empty one and one without words has no
    shingles and is alone, so it is kept; a null doc_id is never the smallest,
    and kept only if no other doc_id is reachable.  An empty table gives no rows.
    """
    found = jaccard.classed(*links(docs, percent, width))
    found = found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, percent: int = 80, width: int = 4) -> DataFrame:
    """The rows of ``docs`` without all but one row of each class, as ``jaccard.keep_first`` chooses it."""
    return jaccard.keep_first(docs, percent, width, links)


def op13(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
