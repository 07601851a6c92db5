"""Token ids in length-delimited binary records, with an offset index.

A record is a frame: the payload's length (unsigned 64-bit), a masked checksum
of those eight bytes, the payload, a masked checksum of the payload, and a line
feed.  The payload is one byte of flags (1: doc_id is null; 2: ids of 32 bits,
else 16), doc_id (signed 64-bit) and the ids.  All numbers are little-endian;
the checksum is CRC-32, masked by a rotation and a constant, so that checksums
of data holding checksums stay sound.

Files are written by Spark's text sink, whose line feed ends each frame: any
file system Spark can write to will do, and the committer makes retried and
lost tasks harmless.  They lie in the order of doc_id (null first), then of the
text's hash; a file holds a range of that order, so rows that share a doc_id may
lie in several files.  The index is a Parquet table beside them: file, offset
and length of each record, its tokens and the checksum of its ids.

With a byte-level BPE tokenizer no piece crosses a single blank or line break
between two other visible characters, so a text without runs of white space is
cut there, and each distinct word is given to the tokenizer's model once per
worker.  Other texts, texts that hold the string of an added token, and words of
other kinds are encoded whole, as the library does it.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quernstone.llm.kernels import slices
from quernstone.workspace import in_arrow, materialize, new_path

FILE_BYTES = 12 << 20
#: struct formats: length and checksum, a checksum, flags and doc_id.
_HEAD, _SUM, _DOC = "<QI", "<I", "<Bq"
_RUNS = re.compile(r"\s\s")
#: Letters, then ASCII marks without an apostrophe: pieces of their own.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")
#: Words that a worker keeps of each generation; the last two are there, and a word that is used again is of the newest.
CACHE = 450_000


def masked(data: bytes) -> int:
    """The masked CRC-32 of ``data``."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    payload = struct.pack(_DOC, (doc_id is None) | wide << 1, doc_id or 0) + ids
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack(_SUM, masked(size)), payload, struct.pack(_SUM, masked(payload)), b"\n"))


def parse(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """doc_id, ids and the next offset of the frame at ``at``; ValueError if it is damaged."""
    size, check = struct.unpack_from(_HEAD, data, at)
    if check != masked(bytes(data[at : at + 8])) or at + 17 + size > len(data):
        raise ValueError(f"damaged length at {at}")
    payload = bytes(data[at + 12 : at + 12 + size])
    if struct.unpack_from(_SUM, data, at + 12 + size)[0] != masked(payload):
        raise ValueError(f"damaged record at {at}")
    flags, doc_id = struct.unpack_from(_DOC, payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=struct.calcsize(_DOC)).astype("<u4"), at + 17 + size


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if visible, else the next free one from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class Encoder:
    """Texts to bytes of ids, with the tokenizers library."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = "<u4" if self.wide else "<u2"
        how = json.loads(spec)
        level = how.get("pre_tokenizer") or {}
        byte_level = level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and level.get("use_regex", True)
        self.cuts = how["model"].get("type") == "BPE" and not how.get("normalizer") and byte_level
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.known: dict[str, bytes] = {}  # words after a blank
        self.first: dict[str, bytes] = {}  # words at the start of a line
        self.older: dict[str, dict[str, bytes]] = {" ": {}, "": {}}  # the generations before, by what stands before a word
        self.marks: dict[str, bytes] = {}
        self.line = self.whole(["\n"])[0]

    def whole(self, rows: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)]

    def piece(self, text: str) -> bytes:
        """The ids of one piece."""
        letters = text.replace(" ", self.letters[32]) if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        out = array("I" if self.wide else "H", [t.id for t in self.model.tokenize(letters)])
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def word(self, word: str, blank: str = " ") -> bytes:
        """The ids of a word after a blank, or of one at the start of a line."""
        if "\n" in word:
            head, *tail = word.split("\n")
            return self.get(head, blank) + b"".join(self.line + self.get(x, "") for x in tail)
        before = self.older[blank].get(word)
        if before is not None:
            return self.keep(word, blank, before)
        found = _PLAIN.fullmatch(word)
        if not found:
            ids = self.whole([blank + word])[0]
        elif found[2]:
            marks = self.marks.get(found[2])
            if marks is None:
                marks = self.marks[found[2]] = self.piece(found[2])
            ids = self.get(found[1], blank) + marks
        else:
            ids = self.piece(blank + word)
        return self.keep(word, blank, ids)

    def keep(self, word: str, blank: str, ids: bytes) -> bytes:
        known = self.known if blank else self.first
        if len(known) >= CACHE:
            self.older[blank], known = known, {}
            self.marks.clear()
            if blank:
                self.known = known
            else:
                self.first = known
        known[word] = ids
        return ids

    def get(self, word: str, blank: str) -> bytes:
        return (self.known if blank else self.first).get(word) or self.word(word, blank)

    def __call__(self, text: str) -> bytes:
        if not self.cuts or not text or text[0].isspace() or text[-1].isspace() or _RUNS.search(text) or any(t in text for t in self.added):
            return self.whole([text])[0]
        first, *rest = text.split(" ")
        known, word = self.known.get, self.word
        return b"".join([self.get(first, ""), *[known(w) or word(w) for w in rest]])


@lru_cache(2)
def _encoder(spec: str) -> Encoder:
    """The worker's own encoder, kept from task to task."""
    return Encoder(spec)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, file_bytes: int = FILE_BYTES) -> None:
    """Write ``docs(doc_id, text)`` as record files under ``path``.

    ``tokenizer`` is the path of a tokenizers JSON file on the driver; its
    content goes to the workers.  A null or empty text is a record with the end
    id alone; a very long text is one record.  Repeated rows are records of
    their own, side by side, and so are rows with a null doc_id, which come
    first.  However many share a doc_id, files keep their size.  An empty table
    writes no record.
    """
    spec = Path(tokenizer).read_text()
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # one tokenizer's vocabulary
    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        end = b"" if end_id is None else np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            for part in slices(batch, 1, 1 << 20, 256):
                rows = [frame(d, encoder(t or "") + end, encoder.wide) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([r[:-1] for r in rows], pa.binary())], ["record"])  # the sink adds the line feed

    order = [F.col("doc_id").asc_nulls_first(), "h", "row"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order)
    records = in_arrow(rows.select("doc_id", "text"), run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/records")


def index(spark: SparkSession, path: str) -> DataFrame:
    """Read all record files, check every frame, and write the offset index: ``file, offset, length, doc_id, n_tokens, ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, at, rows = memoryview(content.as_buffer()), 0, []
                while at < len(data):
                    doc_id, ids, after = parse(data, at)
                    rows.append((name, at, after - at, doc_id, len(ids), zlib.crc32(ids.tobytes())))
                    at = after
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["file", "offset", "length", "doc_id", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    out = in_arrow(named, run, "file string, offset long, length long, doc_id long, n_tokens long, ids_crc32 long")
    out.write.parquet(f"{path}/index")
    return spark.read.schema(out.schema).parquet(f"{path}/index")


def read(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``doc_id, ids`` of the index rows ``wanted(file, offset)``, by their offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, offsets in zip(batch.column(0), batch.column(1).to_pylist()):
                data = memoryview(content.as_buffer())
                found = [parse(data, at)[:2] for at in offsets]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([ids.tolist() for _, ids in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    asked = wanted.groupBy("file").agg(F.collect_list("offset").alias("offsets"))  # of one file, whose size is bounded
    return in_arrow(files.join(asked, "file").select("content", "offsets"), run, "doc_id long, ids array<long>")


def starts(entries: DataFrame) -> DataFrame:
    """The index with ``start``: the tokens of all records before it.

    Files are numbered by their names.  Sums of files meet in blocks of a
    thousand, and only sums of blocks in one window.
    """
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    sums = entries.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(number / 1000))
    blocks_ = sums.groupBy("block").agg(F.sum("n").alias("n"))
    blocks_ = blocks_.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("outer"))
    inner = F.sum("n").over(Window.partitionBy("block").orderBy("file")) - F.col("n")
    before = materialize(sums.withColumn("inner", inner).join(blocks_, "block").select("file", (F.col("outer") + F.col("inner")).alias("before")), "before")
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("offset")) - F.col("n_tokens")
    return entries.withColumn("inside", inside).join(before, "file").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def op5(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = new_path(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path, tokenizer)
    return starts(index(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset")
