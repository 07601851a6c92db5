"""Table functions for SQL: ``chunks(TABLE(t))`` and ``triplets(TABLE(t))``.

Their result has the columns of the table they are given, but for those that
they use up, so any table with these will do.  They run in Python, row by row, and
are for SQL users; ``operators.chunking.windows`` does the same in the JVM.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quernstone.operators import extraction
from quernstone.operators.chunking import LEAST, OVERLAP, SIZE, check_window


def _others(rows: AnalyzeArgument, *used: str) -> list[StructField]:
    """The columns of a table argument but for those ``used``, which it must have."""
    if not rows.isTable:
        raise ValueError("the first argument must be a table")
    missing = set(used) - set(rows.dataType.names)
    if missing:
        raise ValueError(f"the table has no column {', '.join(sorted(missing))}")
    return [f for f in rows.dataType.fields if f.name not in used]


def _number(given: AnalyzeArgument | None, usual: int) -> int:
    if given is None:
        return usual
    if not given.isConstantExpression:
        raise ValueError("sizes must be constants")
    return int(given.value)


@dataclass
class Window(AnalyzeResult):
    size: int = SIZE
    overlap: int = OVERLAP
    least: int = LEAST


class Chunks:
    """Sliding windows of words of each row's ``text``, numbered and named as ``windows`` does."""

    def __init__(self, window: Window):
        self.window = window

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None, least: AnalyzeArgument | None = None) -> Window:
        _others(rows, "company_ticker", "fiscal_year", "section_id")
        named = _others(rows, "text")
        made = [StructField("chunk_seq", LongType()), StructField("text", StringType()), StructField("token_count", LongType()), StructField("chunk_id", StringType())]
        window = Window(StructType(named + made), size=_number(size, SIZE), overlap=_number(overlap, OVERLAP), least=_number(least, LEAST))
        check_window(window.size, window.overlap)
        return window

    def eval(self, rows: Row, size: int | None = None, overlap: int | None = None, least: int | None = None) -> Iterator[tuple]:
        w, words = self.window, (rows["text"] or "").split()
        starts = [0] if len(words) <= w.size else range(0, len(words), w.size - w.overlap)
        pieces = [p for s in starts if len(p := words[s : s + w.size]) >= w.least]
        kept = tuple(rows[c] for c in rows.__fields__ if c != "text")
        for seq, piece in enumerate(pieces):
            text = " ".join(piece)
            named = [rows["company_ticker"], rows["fiscal_year"], rows["section_id"], 1, seq, text]
            yield (*kept, seq, text, len(piece), hashlib.sha1("|".join(str(x) for x in named if x is not None).encode()).hexdigest()[:32])


class Triplets:
    """The valid triplets of each row's model ``output``; those that name another chunk belong to that one."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        kept = _others(rows, "chunk_id", "output")
        props = MapType(StringType(), StringType())
        made = [StructField(n, props if n.endswith("props") else StringType()) for n in ("chunk_id", "relation", "source", "source_props", "target", "target_props")]
        return AnalyzeResult(StructType(kept + made))

    def eval(self, rows: Row) -> Iterator[tuple]:
        own = None if rows["chunk_id"] is None else str(rows["chunk_id"])
        kept = tuple(rows[c] for c in rows.__fields__ if c not in ("chunk_id", "output"))
        for chunk, raws in extraction.by_chunk(extraction.json_within(extraction.unwrapped(rows["output"])), own).items():
            for source, relation, target in filter(None, map(extraction.triplet, raws)):
                rest = ({k: v for k, v in end.items() if k != "name"} for end in (source, target))
                source_props, target_props = rest
                yield (*kept, chunk if chunk is not None else own, relation, source["name"], source_props, target["name"], target_props)


def register(spark: SparkSession) -> None:
    """Make both known to a session's SQL."""
    spark.udtf.register("chunks", udtf(Chunks))
    spark.udtf.register("triplets", udtf(Triplets))
