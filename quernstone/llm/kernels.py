"""Vectorised text kernels over Arrow string buffers, for ``mapInArrow``.

All work on whole texts.  A batch is cut into blocks of rows with a bounded
number of bytes, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The white space of the word pattern: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``most`` bytes, or a single row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def slices(batch: pa.RecordBatch, text: int, most: int = 1 << 20, wide: int = 512) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``wide`` rows whose texts hold at most ``most`` bytes, or of a single row."""
    _, offsets = utf8(batch.column(text))
    for i, j in blocks(offsets, most):
        for k in range(i, j, wide):
            yield batch.slice(k, min(wide, j - k))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each lower-cased word, and its row."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    inside = ~SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[rows] = inside[rows]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    span = np.diff(np.append(at, n))
    place = np.arange(at[0], n) - np.repeat(at, span)
    part = _powers(_BASE, int(span.max()))[place]
    part *= LOWER[data[at[0] :]].astype(U64) + U64(1)
    part[~inside[at[0] :]] = 0
    return mix(np.add.reduceat(part, at - at[0])), np.searchsorted(offsets, at, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes row after row, and the offsets of the rows.

    A row with fewer words than ``width`` has its whole sequence as its only
    shingle; a row without words has none.
    """
    n = len(offsets) - 1
    hashes, row = words(data, offsets)
    counts = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    power = _powers(_STEP, width)
    have = np.maximum(counts - width + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(have)])
    out = np.zeros(bounds[-1], U64)
    if len(out):
        start = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], have)
        length = np.repeat(np.minimum(counts, width), have)
        last = len(hashes) - 1
        for k in range(width):
            part = hashes[np.minimum(start + k, last)] * power[k]
            part[length <= k] = 0
            out += part
        out = mix(out + length.astype(U64))
    for i in np.flatnonzero(have > 1):
        out[bounds[i] : bounds[i + 1]].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[bounds[:-1][have > 0]] = True
    owner = np.repeat(np.arange(n), have)[fresh]
    return out[fresh], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, np.int64))])


def fingerprint(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each row's set; 0 stands for the empty set."""
    out = np.zeros(len(bounds) - 1, U64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        sums = np.add.reduceat(mix(values ^ U64(0xA5A5A5A5DEADBEEF)), bounds[:-1][full])
        out[full] = np.maximum(mix(sums + (bounds[1:] - bounds[:-1])[full].astype(U64)), U64(1))
    return out


def texts(column: pa.Array) -> list[str]:
    """Python strings; null is empty."""
    return [x or "" for x in column.to_pylist()]


def codepoints(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows, end to end, and the offsets of the rows."""
    raw = [x.encode("utf-32-le", "surrogatepass") for x in rows]
    return np.frombuffer(b"".join(raw), np.uint32), np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw], dtype=np.int64)]).astype(np.int64)
