"""Vector code compression: product quantisation in exact integers.

Every component ``x`` becomes ``floor(1024 * x)``, a vector is cut into equal
parts, and each part is coded by the nearest entry of its codebook.  Codebooks
are fitted by rounds of assignment and floored means over all vectors, so every
rerun, whatever its partitioning, gives the same entries.

The nearest entry is found by screening.  A float32 matrix product gives
``x . c`` for a block of vectors and all entries; with ``u`` the unit roundoff and
``d`` components it is off by at most ``g * |x| * |c|``, ``g = (d + 4) u /
(1 - (d + 4) u)``, in whatever order the product is summed: ``d`` roundings of the
sum, and those of both inputs.  So each squared distance has an interval; every
entry whose interval overlaps that of the best is computed again in int64, and
equal distances go to the lower index.  Blocks whose components are too large
for float32 are screened in float64 by the same bound, and compared in Python's
integers where int64 could overflow.

A task sends, for each entry, the sum and the number of its parts, in limbs of 32
bits that add up without overflow; the driver holds the codebooks, whose size
depends on the dimension alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quernstone.workspace import in_arrow, materialize, split_join, unused

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors screened at once, and pairs compared exactly at once.
BLOCK, PAIRS = 2048, 1 << 16
_LIMB = 32
_MOST = (1 << 63) - 1


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` components, none null and none infinite or NaN."""
    return (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))


def dimension(table: DataFrame) -> int | None:
    """The length that most vectors have, the longest of several; None without vectors."""
    found = table.filter("embedding IS NOT NULL").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).head()
    return found["dim"] if found else None


def narrow(width: int) -> int:
    """Components up to this size have squared distances over ``width`` of them in int64."""
    return 1 << ((62 - max(width - 1, 1).bit_length()) // 2 - 1)


def integers(values: np.ndarray, limit: int) -> np.ndarray:
    """``floor(SCALE * x)`` for each of finite ``values``; Python's integers if one is beyond ``limit``."""
    if not values.size or np.abs(values).max() * SCALE < limit:
        return np.floor(values * SCALE).astype(np.int64)
    ratios = (float(x).as_integer_ratio() for x in values.flat)
    out = np.empty(values.size, object)
    out[:] = [n * SCALE // d for n, d in ratios]
    return out.reshape(values.shape)


def _peak(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def _screen(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which entries of ``c`` may be nearest to each row of ``x``: those whose intervals overlap the best."""
    most, d = max(_peak(x), _peak(c)), x.shape[1]
    kind = np.float32 if most < 10**17 else np.float64
    if most >= 10**150:
        return np.ones((len(x), len(c)), bool)
    x, c = x.astype(np.float64), c.astype(np.float64)
    u = 2.0**-24 if kind is np.float32 else 2.0**-53
    product = (x.astype(kind) @ c.astype(kind).T).astype(np.float64)
    square = (c * c).sum(1)
    error = (d + 4) * u / (1 - (d + 4) * u) * (1 + 1e-6) * np.sqrt((x * x).sum(1))[:, None] * np.sqrt(square)[None, :]
    # What the lines here round themselves, in float64.
    error = 2 * error + (square[None, :] + 2 * np.abs(product) + 2 * error) * ((d + 8) * 2.0**-52)
    about = square[None, :] - 2 * product
    return about - error <= (about + error).min(1)[:, None]


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` its nearest row of ``c``, the lower index of equals, and the squared distance."""
    rows, cols = np.nonzero(_screen(x, c))
    exact = max(_peak(x), _peak(c)) <= narrow(x.shape[1]) and x.dtype != object and c.dtype != object
    dist = np.zeros(len(rows), np.int64 if exact else object)
    if not exact:
        x, c = x.astype(object), c.astype(object)
    for i in range(0, len(rows), PAIRS):
        gap = x[rows[i : i + PAIRS]] - c[cols[i : i + PAIRS]]
        dist[i : i + PAIRS] = (gap * gap).sum(1)
    best = np.minimum.reduceat(dist, np.searchsorted(rows, np.arange(len(x))))
    hits = np.flatnonzero(dist == best[rows])
    _, first = np.unique(rows[hits], return_index=True)
    return cols[hits[first]], best


def _blocks(column: pa.Array, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer components of the usable vectors, padded to equal parts, a block at a time."""
    width = -(-dim // PARTS)
    limit = narrow(width)
    for at in range(0, len(column), BLOCK):
        part = column.slice(at, BLOCK)
        length = pc.list_value_length(part).fill_null(-1).to_numpy(zero_copy_only=False)
        right = length == dim
        flat = np.asarray(part.flatten().to_numpy(zero_copy_only=False), np.float64)
        values = flat[np.repeat(right, np.maximum(length, 0))].reshape(-1, dim)
        rows, finite = np.flatnonzero(right) + at, np.isfinite(values).all(1)
        rows, values = rows[finite], np.pad(values[finite], ((0, 0), (0, width * PARTS - dim)))
        wide = (np.abs(values) * SCALE >= limit).any(1)
        for some in (~wide, wide):
            if some.any():
                yield rows[some], integers(values[some], limit)


def _sums(books: list[np.ndarray], dim: int):
    """For each cell (an entry's component, or the number of its parts) the sum over a task's vectors, in limbs."""
    k, width = books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((PARTS, k, width + 1), np.int64)
        large: dict[int, int] = {}
        for batch in batches:
            for _, x in _blocks(batch.column(0), dim):
                for p in range(PARTS):
                    part = x[:, p * width : (p + 1) * width]
                    index, _ = nearest(part, books[p])
                    order = np.argsort(index, kind="stable")
                    used, start = np.unique(index[order], return_index=True)
                    totals[p, :, width] += np.bincount(index, minlength=k)
                    added = np.add.reduceat(part[order], start) if width else part[:0]
                    if x.dtype != object:
                        totals[p, used, :width] += added
                        continue
                    for entry, row in zip(used.tolist(), added):
                        for i, v in enumerate(row):
                            cell = (p * k + entry) * (width + 1) + i
                            large[cell] = large.get(cell, 0) + v
        flat = totals.reshape(-1)
        cells = np.flatnonzero(flat)
        out = [(cells, 0, flat[cells] & ((1 << _LIMB) - 1)), (cells, 1, flat[cells] >> _LIMB)]
        for cell, v in large.items():
            limb = 0
            while v not in (0, -1):
                out.append((np.array([cell]), limb, np.array([v & ((1 << _LIMB) - 1)])))
                v, limb = v >> _LIMB, limb + 1
            out.append((np.array([cell]), limb, np.array([v])))
        for cells, limb, v in out:
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(np.full(len(cells), limb, np.int32)), pa.array(v.astype(np.int64))], ["cell", "limb", "value"])

    return run


def _tight(book: np.ndarray) -> np.ndarray:
    """Entries as int64 if they are small enough for it."""
    return book.astype(np.int64) if _peak(book) <= narrow(book.shape[1]) else book.astype(object)


def fit(table: DataFrame, dim: int | None = None, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part position, an array of ``entries`` rows, from all of ``table(vec_id, embedding)``.

    A codebook starts as the parts of the smallest ``vec_id``s, null last, equal
    ones by their components; with fewer vectors it has as many entries.  Each
    round assigns all parts and replaces every used entry by the floored mean of
    its parts.  Vectors that are null, hold null or non-finite components or have
    another length than ``dim`` (by default the most frequent) take no part; a
    dimension that is no multiple of the parts is padded with zeros.  Repeated
    rows count each time.  An empty table gives no codebooks.
    """
    dim = dimension(table) if dim is None else dim
    if dim is None:
        return []
    first = table.filter(usable(F.col("embedding"), dim)).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()
    if not first:
        return []
    width = -(-dim // PARTS)
    seeds = np.pad(np.array([r["embedding"] for r in first], np.float64).reshape(len(first), dim), ((0, 0), (0, width * PARTS - dim)))
    seeds = integers(seeds, narrow(width))
    books = [_tight(seeds[:, p * width : (p + 1) * width]) for p in range(PARTS)]
    for _ in range(rounds):
        sums = in_arrow(table.select("embedding"), _sums(books, dim), "cell long, limb int, value long").groupBy("cell", "limb").agg(F.sum("value").alias("value"))
        totals: dict[int, int] = {}
        got = sums.toArrow()  # a few limbs for each component of the codebooks
        for cell, limb, value in zip(*(got.column(c).to_pylist() for c in ("cell", "limb", "value"))):
            totals[cell] = totals.get(cell, 0) + (value << (_LIMB * limb))
        fresh = [book.astype(object) for book in books]
        for p in range(PARTS):
            for entry in range(len(first)):
                base = (p * len(first) + entry) * (width + 1)
                if n := totals.get(base + width, 0):
                    fresh[p][entry] = [totals.get(base + i, 0) // n for i in range(width)]
        books = [_tight(book) for book in fresh]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256, in lowercase hex, of all entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.reshape(-1)).encode()).hexdigest()


def encode(table: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """``vec_id, label, code, error`` of the usable rows of ``table(vec_id, label, embedding)``.

    ``code`` has two hex digits for each part, ``error`` is the sum of the parts'
    squared distances, null where a long cannot hold it.
    """
    width = -(-dim // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _blocks(batch.column(2), dim):
                found = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(PARTS)]
                codes = np.stack([index for index, _ in found], 1).astype(np.uint8)
                error = sum(d.astype(object) for _, d in found)
                part = batch.take(pa.array(rows))
                made = (pa.array([c.tobytes().hex() for c in codes]), pa.array([int(e) if e <= _MOST else None for e in error], pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], ["vec_id", "label", "code", "error"])

    kinds = (f"{c} {table.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    return in_arrow(table.select("vec_id", "label", "embedding"), run, ", ".join((*kinds, "code string, error long")))


def label_errors(coded: DataFrame) -> DataFrame:
    """A written table with ``error`` and ``label``, with ``label_error``: the sum over the rows of equal labels, nulls together.

    The sum is null where an error of the label is, or where a long cannot hold it.
    """
    key = unused(coded, "_label")
    keyed = coded.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")))
    total = F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error")
    return split_join(keyed, keyed.groupBy(key).agg(total), key, F.xxhash64("vec_id", "code")).drop(key)


def compress(table: DataFrame, dim: int | None = None, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256``, a row for each usable row of ``table(vec_id, label, embedding)``.

    What is usable, and what happens to null ids, ties, repeated rows and other
    lengths, ``fit`` says.  A table without usable vectors gives no rows; other
    columns are not read.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits for each part")
    table = table.select("vec_id", "label", "embedding")
    dim = dimension(table) if dim is None else dim
    books = [] if dim is None else fit(table, dim, entries, rounds)
    if not books:
        kept = table.select("vec_id", "label").limit(0)
        return kept.select("vec_id", "label", *(F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
    return label_errors(materialize(encode(table, books, dim), "codes")).withColumn("codebooks_sha256", F.lit(digest(books)))


def op11(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    return compress(table).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
