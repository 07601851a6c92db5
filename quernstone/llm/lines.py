"""Line deduplication by a segment-partition edit join.

Lines are near-copies when their edit distance is at most one edit for each
``per`` characters of the shorter line, and at most ``edits``.  For each number
``e`` of edits, a line whose length allows ``e`` is cut into ``e + 1`` even
segments; by the pigeonhole principle a near-copy that is not shorter holds one
of them unchanged.  A line signs its own segments, and for each length from its
own down to ``edits`` less, with the edits that this length allows, the
substrings where such a segment can lie (the multi-match-aware window), so that
the signature holds length, segment number and characters.  Lines that meet are
verified by banded bit-parallel edit distance.

A class is a connected component of near-copies.  Of each class the first line
in the order of (doc_id, hash of the text, row, place) stays, once in the whole
corpus.  Blank lines are never dropped.  Equal lines are one member from the
start, by a hash of 64 bits; the members meet as ``meeting`` says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quernstone.llm.components import components
from quernstone.llm.kernels import U64, _powers, codepoints, mix, slices
from quernstone.llm.meeting import connect, gather, packer, task_count
from quernstone.workspace import in_arrow, materialize, split_join, unused

#: At most EDITS edits, and one for each PER characters.
EDITS, PER = 2, 12
CELLS = 128
_BASE = 0x9E3779B97F4A7C15
#: _BASE times this is 1 modulo 2^64.
_INVERSE = pow(_BASE, -1, 1 << 64)


def segments(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and size of each segment of lines of these lengths; the last ones are the longer."""
    small, longer = length // (edits + 1), length % (edits + 1)
    out, start = [], np.zeros_like(length)
    for i in range(edits + 1):
        size = small + (i >= edits + 1 - longer)
        out.append((start, size))
        start = start + size
    return out


def signatures(lines: list[str], edits: int, per: int = PER) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the lines' segments and of the substrings to probe, and the line of each."""
    codes, offsets = codepoints(lines)
    start, n = offsets[:-1], np.diff(offsets)
    power, inverse = _powers(_BASE, len(codes) + 1), _powers(_INVERSE, len(codes) + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum((codes.astype(U64) + U64(1)) * power[: len(codes)], dtype=U64)])
    out, of = [np.zeros(0, U64)], [np.zeros(0, np.int64)]

    def sign(rows: np.ndarray, at: np.ndarray, size: np.ndarray, length: np.ndarray, i: int) -> None:
        a = start[rows] + at
        value = (total[a + size] - total[a]) * inverse[a]
        out.append(mix(value ^ mix(length.astype(U64) * U64(64) + U64(i))))
        of.append(rows)

    for e in range(1, edits + 1):
        for less in range(e + 1):
            length = n - less
            allowed = np.minimum(length // per, edits) == e
            for i, (at, size) in enumerate(segments(length, e)):
                low = np.maximum(np.maximum(at - i, at + less - (e - i)), 0)
                high = np.minimum(np.minimum(at + i, at + less + (e - i)), n - size)
                for shift in range(-e, e + less + 1):
                    where = at + shift
                    own = (less == 0) & (shift == 0)  # the line's own segments
                    rows = np.flatnonzero(allowed & (size > 0) & (own | ((where >= low) & (where <= high))))
                    sign(rows, where[rows], size[rows], length[rows], i)
    return np.concatenate(out), np.concatenate(of)


def distance(a: str, b: str) -> int:
    """Edit distance row by row, for what is left of very short pairs."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def within(left: list[str], right: list[str], edits: int) -> np.ndarray:
    """Which pairs have an edit distance of at most ``edits``, all pairs in step.

    Bit-parallel in a band of ``2 * edits + 1`` diagonals: each pair holds the
    band's vertical differences in two words and moves down one diagonal step
    for each character of the longer line.  ``edits`` may be up to 20.
    """
    out = np.zeros(len(left), bool)
    hard, cores = [], []
    for i, (a, b) in enumerate(zip(left, right)):
        if abs(len(a) - len(b)) > edits:
            continue
        if a == b:
            out[i] = True
            continue
        p = 0
        step = min(len(a), len(b))
        while p < step and a[p] == b[p]:
            p += 1
        q = 0
        while q < step - p and a[-1 - q] == b[-1 - q]:
            q += 1
        a, b = a[p : len(a) - q], b[p : len(b) - q]
        if not a or not b:
            out[i] = max(len(a), len(b)) <= edits
        elif max(len(a), len(b)) <= 2 * edits + 2:
            out[i] = distance(a, b) <= edits
        else:
            hard.append(i)
            cores.append((a, b) if len(a) >= len(b) else (b, a))
    order = sorted(range(len(hard)), key=lambda k: len(cores[k][0]))
    for at in range(0, len(order), 512):
        part = order[at : at + 512]
        ok = _banded([cores[k] for k in part], edits)
        out[[hard[k] for k in part]] = ok
    return out


def _banded(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    """Banded bit-parallel distance of (longer, shorter) pairs whose shorter line has over ``edits`` characters or so."""
    width, k = 2 * edits + 1, len(pairs)
    m, n = (np.array([len(p[s]) for p in pairs]) for s in (0, 1))
    longest = int(m.max())
    text = np.zeros((longest, k), np.uint32)  # the longer line, a row for each place
    band = np.full((longest + width + edits, k), 0xFFFFFFFF, np.uint32)  # the shorter one, shifted by the band
    for i, (a, b) in enumerate(pairs):
        text[: len(a), i] = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
        band[edits : edits + len(b), i] = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    one = U64(1)
    mask = U64((1 << width) - 1)
    # Bit r of column j is row j + r - edits.  In column 0 rows below 0 do not count; the rest rise by one each.
    up, down = np.full(k, mask & ~U64((1 << (edits + 1)) - 1)), np.zeros(k, U64)
    down |= U64((1 << (edits + 1)) - 1) & ~one
    score = np.full(k, edits)  # the value at the band's lowest row, edits below the diagonal
    result = np.full(k, edits + 1)
    for j in range(longest):
        match = np.zeros(k, U64)
        for r in range(width):
            match |= (band[j + r] == text[j]).astype(U64) << U64(r)
        # The window has moved down a row: last column's differences stand one bit lower.
        vp, vn = ((up >> one) | U64(1 << (width - 1))) & mask, (down >> one) & mask
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & mask
        hp, hn = vn | (~(d0 | vp) & mask), d0 & vp
        score = score + 1 - ((d0 >> U64(width - 1)) & one).astype(int)
        x = (hp << one) & mask
        up, down = ((hn << one) | (~(d0 | x) & mask)) & mask, d0 & x
        done = m == j + 1
        if done.any():
            # From the lowest row up to row n: the differences below it are taken off.
            rise = j + 1 + edits - n
            value = score.copy()
            for r in range(width - 1, 0, -1):
                use = (width - 1 - r) < rise
                value -= np.where(use, ((up >> U64(r)) & one).astype(int) - ((down >> U64(r)) & one).astype(int), 0)
            result[done] = value[done]
    return result <= edits


def _signed(edits: int, per: int, buckets: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, 1, 1 << 19, 4096):
                fresh: dict[int, int] = {}
                for i, line_id in enumerate(part.column(0).to_pylist()):
                    if line_id not in seen:
                        fresh[line_id] = i
                if len(seen) > 200_000:  # the memory of what this task has signed is bounded
                    seen.clear()
                seen.update(fresh)
                sig, of = signatures(part.column(1).take(pa.array(fresh.values(), pa.int64())).to_pylist(), edits, per)
                yield sig, np.array(list(fresh), np.int64).view(U64)[of]

    return lambda batches: packer(signed(batches), buckets)


def _verified(edits: int, per: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(i).to_pylist() for i in (2, 3))
            allowed = np.array([min(edits, min(len(a), len(b)) // per) for a, b in zip(left, right)], int)
            good = np.zeros(batch.num_rows, bool)
            for e in range(1, edits + 1):
                some = np.flatnonzero(allowed == e)
                good[some] = within([left[i] for i in some], [right[i] for i in some], e)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many characters of each line fall into each of CELLS cells, and how many pairs of neighbours."""
    for batch in batches:
        for part in slices(batch, 1, 1 << 20, 4096):
            codes, offsets = codepoints(part.column(1).to_pylist())
            n, code = np.diff(offsets), codes.astype(U64)
            of = np.repeat(np.arange(len(n)), n)
            same = of[1:] == of[:-1]
            pair = mix(code[:-1] * U64(0x110000) + code[1:])[same] % U64(CELLS)
            counts = []
            for row, cell in ((of, code % U64(CELLS)), (of[1:][same], pair)):
                counts.append(np.bincount(row * CELLS + cell.astype(np.int64), minlength=len(n) * CELLS).reshape(-1, CELLS))
            counts = np.minimum(np.concatenate(counts, 1), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array([c.tobytes() for c in counts], pa.binary())], ["node", "size", "sketch"])


def _possible(edits: int, per: int):
    """An edit changes at most two cells of characters by one each, and at most four of pairs."""

    def possible(s: np.ndarray, n: np.ndarray, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        allowed = np.minimum(np.minimum(n, m) // per, edits)
        out = np.abs(n - m) <= allowed
        at = np.flatnonzero(out)
        for i in range(0, len(at), 16384):
            k = at[i : i + 16384]
            apart = np.abs(s[k].astype(np.int16) - t[k])
            out[k] = (apart[:, :CELLS].sum(1) <= 2 * allowed[k]) & (apart[:, CELLS:].sum(1) <= 4 * allowed[k])
        return out

    return possible


def exploded(docs: DataFrame) -> DataFrame:
    """``place, line`` after the columns of ``docs``: the lines of each text, from place 0; a null text has one null line without a place."""
    return docs.select(*(c for c in docs.columns if c != "text"), F.posexplode_outer(F.split("text", "\n")).alias("place", "line"))


def _decided(rows: DataFrame, edits: int, per: int) -> DataFrame:
    """``row, doc_id, n_lines, n_kept, dropped`` of ``rows(row, doc_id, text_hash, text)``."""
    spark = rows.sparkSession
    lines = exploded(rows).withColumn("line_id", F.when(F.trim("line") != "", F.xxhash64("line")))
    places = materialize(lines.select("row", "doc_id", "text_hash", "place", "line_id"), "places")
    long_ = exploded(rows.select("text")).filter((F.trim("line") != "") & (F.length("line") >= per)).select(F.xxhash64("line").alias("line_id"), "line")
    n = places.count()
    # A line of length l probes at most so many substrings: its segments for each length, at each shift.
    most = sum((edits + 1) * (2 * edits + 1 + less) for less in range(edits + 1))
    tasks = task_count(spark, n * most // 4)
    packed = in_arrow(long_, _signed(edits, per, tasks * 8), "bucket int, sigs binary, members binary")
    pairs, members = gather(packed, tasks)
    wanted = materialize(pairs.select(F.col("a").alias("line_id")).union(pairs.select("b")).distinct(), "wanted", n)
    met = split_join(long_, wanted, "line_id", F.monotonically_increasing_id(), "left_semi", rows=places)
    met = materialize(met.groupBy("line_id").agg(F.min("line").alias("line")), "met")

    def verify(found: DataFrame) -> DataFrame:
        a, b = (met.select(F.col("line_id").alias(k), F.col("line").alias(f"{k}_line")) for k in "ab")
        both = split_join(split_join(found, a, "a", F.xxhash64("b")), b, "b", F.xxhash64("a"), rows=found)
        return in_arrow(both.select("a", "b", "a_line", "b_line"), _verified(edits, per), "a long, b long")

    sketches = materialize(in_arrow(met.select("line_id", "line"), _sketches, "node long, size long, sketch binary"), "sketches")
    names = components(connect(pairs, members, verify, sketches, _possible(edits, per))).select(F.col("node").alias("line_id"), "root")
    spread = F.xxhash64("row", "place")
    named = split_join(places, names, "line_id", spread, "left").withColumn("root", F.coalesce("root", "line_id"))
    named = materialize(named.drop("line_id"), "named_lines", n)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "row", "place")
    first = named.filter("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select("root", F.col("first.row").alias("first_row"), F.col("first.place").alias("first_place"))
    marked = split_join(named, materialize(first, "first", n), "root", spread, "left")
    is_first = F.col("first_row").isNull() | ((F.col("place") == F.col("first_place")) & (F.col("row") == F.col("first_row")))
    kept = F.count(F.when(F.col("place").isNotNull() & is_first, 1)).alias("n_kept")
    gone = F.array_sort(F.collect_list(F.when(~is_first, F.col("place")))).alias("dropped")
    return marked.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("place").alias("n_lines"), kept, gone)


def _rows(docs: DataFrame, row: Column) -> DataFrame:
    return docs.select(row.alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")


def decide(docs: DataFrame, edits: int = EDITS, per: int = PER) -> DataFrame:
    """``doc_id, n_lines, n_kept, dropped``, a row for each row of ``docs(doc_id, text)``.

    ``dropped`` are the places (from 0) of lines that have an earlier copy or
    near-copy, in ascending order.  A null text has no line, an empty one a
    blank line; a very long text or line counts whole.  Rows that repeat a
    doc_id are documents of their own, ordered by a hash of their text; of
    equal rows one comes first, whichever.  A null doc_id comes after all
    others.  An empty table gives no rows.
    """
    return _decided(_rows(docs, F.monotonically_increasing_id()), edits, per).drop("row")


def apply(docs: DataFrame, edits: int = EDITS, per: int = PER) -> DataFrame:
    """``docs`` with the dropped lines taken out of each text; rows and columns stay."""
    row, gone = unused(docs, "_row"), unused(docs, "_gone")
    whole = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "whole")
    rows = _rows(whole, F.col(row))
    decided = _decided(rows, edits, per).filter(F.size("dropped") > 0).select(F.col("row").alias(row), F.col("dropped").alias(gone))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.array_contains(F.col(gone), i), F.lit(False))), "\n")
    out = whole.join(decided, row, "left")
    return out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)).select(docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    return decide(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
