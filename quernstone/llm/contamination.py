"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is contained in a document if at least ``percent`` of its distinct
5-word shingles are in the document.  Items are partitioned by their number of
shingles (powers of two); in a partition whose largest item has ``hi``
shingles, each item's sketch is its ``floor((1 - t) * hi) + 1`` smallest shingle
hashes, a bottom-k MinHash.  A document has a sketch for each partition: all its
hashes up to that partition's largest sketch value, so that sketches of a short
item and of a document of any length compare for containment, and the tiny items
of one partition do not lengthen the sketches for the others.  A value carries
its partition in its last six bits, so values of two partitions never meet.  By the
pigeonhole principle a document that contains an item with ``n`` shingles has
all but ``floor((1 - t) * n)`` values of the item's sketch, and nothing is
missed.  (Banded MinHash signatures of whole documents cannot find a short item
in a long one: their Jaccard similarity may be under 0.001.)  Candidates are
verified on the words of the shingles themselves.

Items and documents meet in joins, however many there are of either.  A bit
table of each partition's sketches, all of a bounded size, goes to all tasks, so
that only values that an item of the partition may hold leave a document.  Documents are read twice
and are not shuffled, except those with candidates.  Equal texts are one
candidate; a text's identity is its MD5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quernstone.llm.kernels import U64, blocks, shingles, utf8
from quernstone.workspace import in_arrow, materialize, split_join, unused

#: The bit tables have at most 2^BITS bits together, and bits for each sketch value.
BITS, SPARSE = 26, 32
#: The bits of a value that hold its partition.
PART = 63
#: The keys of so many texts may be sent to all tasks; more are joined.
SENT, SALTS = 100_000, 64
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text: str | None, width: int = 5) -> set[tuple[str, ...]]:
    """The distinct shingles of a text, as words."""
    words = _WORD.findall((text or "").translate(_LOWER))
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, min(len(words), 1)))}


def identity(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _sketches(percent: int, width: int):
    """``item, need, value``: the sketch of each text with its partition, and how many of its values a document must hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in blocks(offsets):
                values, bounds = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                n = np.diff(bounds)
                part = np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
                hi = 1 << part
                k = np.minimum((100 - percent) * hi // 100 + 1, n)
                need = k - (100 - percent) * n // 100
                place = np.arange(len(values)) - np.repeat(bounds[:-1], n)  # sorted: the smallest come first
                kept = place < np.repeat(k, n)
                row = np.repeat(np.arange(len(n)), n)[kept]
                item = batch.column(0).slice(i, j - i).take(pa.array(row))
                value = (values[kept] & ~U64(PART)) | part[row].view(U64)
                yield pa.RecordBatch.from_arrays([item, pa.array(need[row]), pa.array(value.view(np.int64))], ["item", "need", "value"])

    return run


def _bit_tables(sketches: DataFrame) -> list[tuple[int, int, int, np.ndarray]]:
    """For each partition its number, largest sketch value, and ``bits`` with a table that has a bit set for the first ``bits`` bits of each value."""
    flip = F.lit(-(1 << 63))  # values are unsigned: flipped, they order as signed ones do
    part = F.col("value").bitwiseAND(F.lit(PART))
    ends = sketches.groupBy(part.alias("part")).agg(F.max(F.col("value").bitwiseXOR(flip)).bitwiseXOR(flip).alias("top"), F.count("*").alias("n")).collect()  # at most PART + 1 rows
    if not ends:
        return []
    share = (len(ends) - 1).bit_length()  # a document's value is probed in each partition
    bits = {r["part"]: int(min(BITS - share, max(12, (SPARSE * r["n"] - 1).bit_length() + share))) for r in ends}
    drop = F.element_at(F.create_map(*[F.lit(x) for p, b in bits.items() for x in (p, 64 - b)]), F.col("part"))
    at = sketches.select(part.alias("part"), "value").select("part", F.call_function("shiftrightunsigned", "value", drop).alias("at"))
    words = at.select("part", F.shiftright("at", 6).alias("word"), F.expr(f"shiftleft(1L, CAST(at & {PART} AS INT))").alias("bit"))
    found = words.groupBy("part", "word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = []
    for r in ends:
        table, own = np.zeros(1 << (bits[r["part"]] - 6), np.int64), found[found["part"] == r["part"]]
        table[own["word"].to_numpy(np.int64)] = own["bits"].to_numpy(np.int64)
        out.append((int(r["part"]), int(np.int64(r["top"]).view(U64)), bits[r["part"]], table.view(U64)))
    return out


def _probe(tables, width: int):
    """``text_key, value``: the values of each document's sketch for each partition that an item of the partition may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = tables.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in blocks(offsets):
                values, bounds = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                for part, top, bits, words in parts:
                    own = (values & ~U64(PART)) | U64(part)
                    short = np.flatnonzero(own <= U64(top))
                    at = own[short] >> U64(64 - bits)
                    hit = short[((words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1)).astype(bool)]
                    rows = np.searchsorted(bounds, hit, "right") - 1
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(rows)), pa.array(own[hit].view(np.int64))], ["text_key", "value"])

    return run


def _verified(percent: int, width: int):
    """Exact containment, row by row; the rows of one document come together, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, have = None, set()
        for batch in batches:
            counts = []
            for key, text, item in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if key != last:
                    last, have = key, shingle_set(text.as_py(), width)
                want = shingle_set(item.as_py(), width)
                counts.append((len(want), len(want & have)))
            n, common = np.array(counts, np.int32).reshape(-1, 2).T
            good = pa.array(100 * common.astype(np.int64) >= percent * n.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.select([0, 1]).columns, pa.array(n), pa.array(common)], ["text_key", "item", "n_item", "n_common"]).filter(good)

    return run


def _only(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The ``rows`` whose text_key is in the written table ``found``; a text that many rows share is dealt over the salts."""
    keys = materialize(found.select("text_key").distinct(), "keys")
    if keys.count() <= SENT:
        return rows.join(F.broadcast(keys), "text_key", "left_semi")
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    keys = keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.join(keys.hint("shuffle_hash"), ["text_key", "salt"], "left_semi").drop("salt")


def _found(docs: DataFrame, items: DataFrame, percent: int, width: int) -> DataFrame | None:
    """``text_key, item, n_item, n_common`` of the different texts that contain the different items; None without items."""
    spark = docs.sparkSession
    known = items.select(identity(F.col("text")).alias("item"), F.coalesce("text", F.lit("")).alias("item_text")).dropDuplicates(["item"])
    known = materialize(known, "items")
    sketches = materialize(in_arrow(known, _sketches(percent, width), "item string, need long, value long"), "sketches")
    tables = _bit_tables(sketches)
    if not tables:
        return None
    probe = _probe(spark.sparkContext.broadcast(tables), width)  # at most 2^BITS bits
    texts = docs.select(identity(F.col("text")).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    hits = materialize(in_arrow(texts, probe, "text_key string, value long").distinct(), "hits")
    met = split_join(hits, sketches, "value", F.xxhash64("text_key"))
    pairs = met.groupBy("text_key", "item").agg(F.count("*").alias("n"), F.first("need").alias("need")).filter("n >= need")
    pairs = materialize(pairs.select("text_key", "item"), "candidates")
    one = _only(texts, pairs).groupBy("text_key").agg(F.first("text").alias("text"))
    both = split_join(split_join(pairs, known, "item", F.xxhash64("text_key")), materialize(one, "texts"), "text_key", F.xxhash64("item"), rows=pairs)
    return in_arrow(both.select("text_key", "item", "text", "item_text"), _verified(percent, width), "text_key string, item string, n_item int, n_common int")


def leaks(docs: DataFrame, items: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """``doc_id, item_id, n_item, n_common``, a row for each leaked item of each row of ``docs``.

    An item with fewer words than ``width`` is found only where it is the whole
    text; an item without words, and a null or empty text, is never found.
    Repeated documents and items each give their rows; null ids are ids like
    others.  A very long text is searched as a whole.  Empty tables on either
    side give no rows; other columns are not read.
    """
    rows = docs.select("doc_id", identity(F.col("text")).alias("text_key"))
    names = items.select("item_id", identity(F.col("text")).alias("item"))
    found = _found(docs, items, percent, width)
    if found is None:
        return rows.join(names.withColumnRenamed("item", "text_key"), "text_key").select("doc_id", "item_id", F.lit(0).alias("n_item"), F.lit(0).alias("n_common")).limit(0)
    found = materialize(found, "found")
    rows = materialize(_only(rows, found), "rows")
    names = materialize(names, "names")
    out = split_join(rows, found, "text_key", F.xxhash64("doc_id"))
    return out.join(names, "item").select("doc_id", "item_id", "n_item", "n_common")


def clean(docs: DataFrame, items: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns.

    Null, empty and wordless texts stay; a very long text is searched as a
    whole; repeated rows stay or go together, whatever their ids.  Without
    items every row stays.
    """
    found = _found(docs, items, percent, width)
    if found is None:
        return docs
    key, salt = unused(docs, "_key"), unused(docs, "_salt")
    gone = materialize(found.select(F.col("text_key").alias(key)).distinct(), "gone")
    out = docs.withColumn(key, identity(F.col("text")))
    if gone.count() <= SENT:
        return out.join(F.broadcast(gone), key, "left_anti").select(docs.columns)
    # A text that many rows share is dealt over the salts.
    out = out.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    gone = gone.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return out.join(gone, [key, salt], "left_anti").select(docs.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    out = leaks(docs, items)
    return out.withColumn("containment", F.round(F.col("n_common") / F.col("n_item"), 6))
