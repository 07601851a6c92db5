"""N-gram Jaccard join by PartEnum signatures.

Texts become sets of hashed 5-word shingles; two sets link when their Jaccard
similarity is ``percent`` / 100 or more.  Sets are put into size bands whose ends
grow by 100 / percent, so linked sets lie in one band or in neighbours; each set
is signed for its own band and the next.  In a band linked sets differ in at
most ``k`` elements.  The domain is partitioned by hash into ``k // 2 + 1``
parts, so at least one part holds at most one difference; a part is cut into
three, and each choice of two of the three is one signature.

Signatures of fewer than ``LEAST`` elements are withheld, as unrelated texts
share them.  Both sets of a pair withhold the signature that they share, or
neither does.  So the rest is found exactly: a set that withholds a signature is
also looked up by the prefix of its elements in one order for all sets, and
linked sets share an element of their prefixes.  Shingles that many texts hold
come last in that order, so that they seldom make candidates; which ones these
are is read from a sample, and any choice of them finds the same links.

Bands of more than ``parts`` parts (sets of over 277 shingles at 75 percent)
enumerate only so many of their parts, which are random: at the threshold itself
each of 40 agrees with a probability of over 0.3, so all of them fail for less
than one pair in a million.  ``parts=None`` enumerates all, and misses nothing
whatever the size.

Equal sets are one member from the start.  The members meet as ``meeting``
says, and every link is verified on the whole sets.  A set's identity is its
fingerprint of 64 bits; that two unequal sets have one is as likely as one in
2^64 for each pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quernstone.llm.components import components
from quernstone.llm.kernels import U64, blocks, fingerprint, mix, shingles, utf8
from quernstone.llm.meeting import connect, gather, packer, task_count
from quernstone.workspace import in_arrow, is_empty, materialize, split_join, unused

#: Parts enumerated at most (None: all), and elements of a signature at least.
PARTS, LEAST = 40, 3
#: Rows read for the common shingles, how many of them hold one, and how many shingles are told apart.
SAMPLE, OFTEN, COMMON = 10_000, 4, 32_768
CELLS = 512


def bands(percent: int) -> np.ndarray:
    """The largest size of each band."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 100 // percent, out[-1] * 101 // 100))
    return np.array(out)


def parts_of(end: np.ndarray, percent: int) -> np.ndarray:
    """The number of parts for sets of a band that ends there."""
    return 2 * (100 - percent) * end // (100 + percent) // 2 + 1


def prefix_of(size: np.ndarray, percent: int) -> np.ndarray:
    """How many elements of a set are its prefix: linked sets share one of them in any common order."""
    return np.where(size > 0, size + (-percent * size // 100) + 1, 0)


def prefixes(values: np.ndarray, bounds: np.ndarray, length: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``length`` elements of each set, those in ``common`` (sorted) after all others, and the set of each."""
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    late = np.zeros(len(values), bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, values), len(common) - 1)] == values
    before = np.concatenate([[0], np.cumsum(~late)])
    early = before[:-1] - before[bounds[:-1]][owner]
    place = np.arange(len(values)) - bounds[:-1][owner]
    rank = np.where(late, place - early + (before[bounds[1:]] - before[bounds[:-1]])[owner], early)
    kept = rank < length[owner]
    return mix(values[kept] ^ U64(0x5851F42D4C957F2D)), owner[kept]


def enumerated(values: np.ndarray, bounds: np.ndarray, percent: int, parts: int | None = PARTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """PartEnum signatures of the sets in ``values`` between ``bounds``, the set of each, and which sets withhold some in a band with all parts."""
    size, ends = np.diff(bounds), bands(percent)
    withheld, out, of = np.zeros(len(size), bool), [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    chosen = np.flatnonzero(size > 0)
    if len(chosen):
        scrambled = mix(values + U64(0x2545F4914F6CDD1D))
        low, high = values & U64(0xFFFFFFFF), values >> U64(32)
        band = np.searchsorted(ends, size[chosen])
        row = np.repeat(np.arange(len(chosen)), size[chosen])
        for tag in (band, band + 1):
            total = parts_of(ends[tag], percent)
            used = total if parts is None else np.minimum(total, parts)
            base = np.concatenate([[0], np.cumsum(used)])
            part = (high * total[row].astype(U64) >> U64(32)).astype(np.int64)
            take = np.flatnonzero(part < used[row])
            cell = (base[row[take]] + part[take]) * 3 + (low[take] * U64(3) >> U64(32)).astype(np.int64)
            sums = np.zeros(base[-1] * 3, U64)
            np.add.at(sums, cell, scrambled[take])
            sums, count = sums.reshape(-1, 3), np.bincount(cell, minlength=base[-1] * 3).reshape(-1, 3)
            who = np.repeat(np.arange(len(chosen)), used)
            salt = mix((tag[who] * 1_000_003 + np.arange(base[-1]) - base[who]).astype(U64))
            for j, subset in enumerate(combinations(range(3), 2)):
                some = list(subset)
                good = count[:, some].sum(1) >= LEAST
                out.append(mix(sums[:, some].sum(1, dtype=U64) + salt + U64(j))[good])
                of.append(chosen[who[good]])
                withheld[chosen[who[~good & (used == total)[who]]]] = True
    return np.concatenate(out), np.concatenate(of), withheld


def signatures(values: np.ndarray, bounds: np.ndarray, percent: int, common: np.ndarray = np.zeros(0, U64), parts: int | None = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of the sets, prefixes included, and the set of each."""
    sig, of, withheld = enumerated(values, bounds, percent, parts)
    single, whose = prefixes(values, bounds, np.where(withheld, prefix_of(np.diff(bounds), percent), 0), common)
    return np.concatenate([sig, single]), np.concatenate([of, whose])


def expected(size: np.ndarray, percent: int, parts: int | None = PARTS) -> np.ndarray:
    """At most so many signatures has a set of each size."""
    ends = bands(percent)
    band = np.searchsorted(ends, size)
    total = (parts_of(ends[b], percent) for b in (band, band + 1))
    return np.where(size > 0, sum(3 * (t if parts is None else np.minimum(t, parts)) for t in total), 0) + prefix_of(size, percent)


def _profile(width: int, cost: Callable[[np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in blocks(offsets):
                values, bounds = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                size = np.diff(bounds)
                part = batch.slice(i, j - i)
                made = (size, fingerprint(values, bounds).view(np.int64), cost(size))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *map(pa.array, made)], ["doc_id", "text_hash", "n_shingles", "fp", "n_sigs"])

    return run


def _fresh(seen: set, fps: np.ndarray) -> np.ndarray:
    """Which sets this task has not met before; the memory of it is bounded."""
    if len(seen) > 200_000:
        seen.clear()
    out = np.zeros(len(fps), bool)
    for i, f in enumerate(fps.tolist()):
        if f and f not in seen:
            seen.add(f)
            out[i] = True
    return out


def _pick(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.repeat(rows, np.diff(bounds))
    return values[mask], np.concatenate([[0], np.cumsum(np.diff(bounds)[rows])]).astype(np.int64)


def _elements(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in blocks(offsets):
                values, _ = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], ["item"])

    return run


def common_elements(docs: DataFrame, rows: int, width: int) -> np.ndarray:
    """The elements that most rows of a sample hold, sorted; they order the prefixes and decide nothing else."""
    sample = docs.select("text").sample(min(1.0, SAMPLE / max(rows, 1)), 5)
    counts = in_arrow(sample, _elements(width), "item long").groupBy("item").count().filter(F.col("count") >= OFTEN)
    found = counts.orderBy(F.desc("count"), "item").limit(COMMON).collect()
    return np.sort(np.array([r["item"] for r in found], np.int64).view(U64))


def _sign(width: int, buckets: int, sign: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        seen: set = set()
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in blocks(offsets):
                values, bounds = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                fps = fingerprint(values, bounds)
                fresh = _fresh(seen, fps)
                sig, of = sign(*_pick(values, bounds, fresh))
                yield sig, fps[fresh][of]

    return lambda batches: packer(signed(batches), buckets)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in blocks(offsets):
                values, bounds = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                fps = fingerprint(values, bounds)
                fresh = _fresh(seen, fps)
                values, bounds = _pick(values, bounds, fresh)
                yield pa.RecordBatch.from_arrays([pa.array(fps[fresh].view(np.int64)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))], ["fp", "items"])

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many elements of each set fall into each of CELLS cells."""
    for batch in batches:
        items = batch.column(1)
        values, size = items.flatten().to_numpy().view(U64), np.diff(items.offsets.to_numpy())
        cell = np.repeat(np.arange(len(size)), size) * CELLS + (values % U64(CELLS)).astype(np.int64)
        counts = np.minimum(np.bincount(cell, minlength=len(size) * CELLS), 255).astype(np.uint8).reshape(-1, CELLS)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int64)), pa.array([c.tobytes() for c in counts], pa.binary())], ["node", "size", "sketch"])


def _possible(percent: int) -> Callable[..., np.ndarray]:
    """The elements that two sets share are at most the smaller counts of their cells."""

    def possible(s: np.ndarray, n: np.ndarray, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        out = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        at = np.flatnonzero(out)
        for i in range(0, len(at), 4096):
            k = at[i : i + 4096]
            a, b = s[k], t[k]
            common = np.minimum(a, b).sum(1, dtype=np.int64)
            full = ((a == 255) | (b == 255)).any(1)  # counts cut off bound nothing
            out[k] = full | (100 * common >= percent * (n[k] + m[k] - common))
        return out

    return possible


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of a written table whose sets reach the threshold, by whole intersections."""
    a, b = (sets.select(F.col("fp").alias(k), F.col("items").alias(f"{k}_items")) for k in "ab")
    both = split_join(split_join(pairs, a, "a", F.xxhash64("b")), b, "b", F.xxhash64("a"), rows=pairs)
    both = both.withColumn("common", F.size(F.array_intersect("a_items", "b_items")))
    return both.filter(F.col("common") * 100 >= percent * (F.size("a_items") + F.size("b_items") - F.col("common"))).select("a", "b")


def join(docs: DataFrame, percent: int, width: int, cost: Callable[[np.ndarray], np.ndarray], signer: Callable[[DataFrame, int], Callable]) -> tuple[DataFrame, DataFrame]:
    """``(profile, edges)`` of ``docs(doc_id, text)``.

    ``profile``: doc_id, n_shingles and the fingerprint ``fp`` of the set for
    each row.  ``edges``: linked pairs ``(a, b)`` of fingerprints that connect
    every component.  ``cost`` says how many signatures sets of some sizes have
    at most, ``signer(docs, rows)`` gives the function that makes them and says
    whose they are, from sets of hashes between bounds.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n_shingles long, fp long, n_sigs long"
    profile = materialize(in_arrow(docs, _profile(width, cost), schema), "profile")
    rows, total = profile.agg(F.count("*"), F.sum("n_sigs")).head()
    tasks = task_count(docs.sparkSession, total or 0)
    packed = in_arrow(docs.select("text"), _sign(width, tasks * 8, signer(docs, rows)), "bucket int, sigs binary, members binary")
    pairs, members = gather(packed, tasks)
    wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "fp")
    one = profile.groupBy("fp").agg(F.min("text_hash").alias("text_hash"))
    hashes = one.join(wanted, "fp", "left_semi").select("text_hash").distinct()
    texts = split_join(docs.select("text", "text_hash"), hashes, "text_hash", F.monotonically_increasing_id(), "left_semi", rows=profile).select("text")
    sets = in_arrow(texts, _sets(width), "fp long, items array<long>")
    sets = materialize(sets.groupBy("fp").agg(F.first("items").alias("items")), "sets")
    sketches = materialize(in_arrow(sets, _sketches, "node long, size long, sketch binary"), "sketches")
    return profile, connect(pairs, members, lambda found: verify(found, sets, percent), sketches, _possible(percent))


def links(docs: DataFrame, percent: int = 75, width: int = 5, parts: int | None = PARTS) -> tuple[DataFrame, DataFrame]:
    """``join`` by the signatures of this module."""

    def signer(docs: DataFrame, rows: int) -> Callable:
        common = common_elements(docs, rows, width)
        return lambda values, bounds: signatures(values, bounds, percent, common, parts)

    return join(docs, percent, width, lambda size: expected(size, percent, parts), signer)


def classed(profile: DataFrame, edges: DataFrame) -> DataFrame:
    """The profile with ``component_id`` and ``root``, a name that a class has alone; both are null without shingles."""
    names = components(edges)
    first = profile.filter("fp <> 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    first = first.join(names.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    n = profile.count()
    first = materialize(first, "least", n)
    whole = first.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")).filter("n > 1")
    first = first.join(whole, "root", "left").select("fp", "root", F.coalesce("component_id", "least").alias("component_id"))
    return split_join(profile, materialize(first, "first", n), "fp", F.xxhash64("doc_id", "text_hash"), "left")


def classes(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id``, a row for each row of ``docs``.

    ``component_id`` is the smallest doc_id reachable by links, the row's own
    included.  Equal sets link, so repeated rows share a component.  A null
    text, an empty one and one without words has no shingles and is alone; a
    null doc_id is never the smallest.  An empty table gives no rows.
    """
    return classed(*links(docs, percent, width)).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, percent: int = 75, width: int = 5, find: Callable[..., tuple[DataFrame, DataFrame]] = links) -> DataFrame:
    """The rows of ``docs`` without all but one row of each class; its columns stay, whatever their names.

    The row with the smallest doc_id stays, null last, then the one with the
    smallest hash of its text, then of all columns, written as JSON.  Only rows
    of the same class go, whatever doc_id they share with others; rows without
    shingles all stay.  ``find`` gives the classes.
    """
    text, doc, hash_, row = (unused(docs, x) for x in ("_text", "_doc", "_hash", "_row"))
    out = materialize(classed(*find(docs, percent, width)).select("doc_id", "text_hash", "root", "component_id"), "classes").filter("root IS NOT NULL")
    heads = out.filter("doc_id <=> component_id").groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    heads = materialize(heads, "heads", out.count())
    heads = heads.join(heads.groupBy("root").agg(F.min("text_hash").alias("least")), "root")
    key = (F.col("doc_id").alias(doc), F.col("text_hash").alias(hash_))
    drop = out.filter("NOT (doc_id <=> component_id)").select(*key).union(heads.filter("text_hash <> least").select(*key)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(text) == F.col(hash_))
    kept = docs.withColumn(text, F.xxhash64("text")).join(drop.hint("shuffle_hash"), same, "left_anti")
    repeated = materialize(heads.filter("text_hash = least AND n > 1").select(*key), "repeated", 0)
    if is_empty(repeated):
        return kept.select(docs.columns)
    whole = F.struct(*docs.columns)
    one = kept.join(repeated, same, "left_semi").groupBy("doc_id", text).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(row)).select(f"{row}.*")
    return kept.join(repeated, same, "left_anti").select(docs.columns).union(one)


def op9(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
