"""Raw filings to sections and chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quernstone.functions.scalars import tokens
from quernstone.functions.tables import SECTION_ITEMS
from quernstone.workspace import spread

SIZE, OVERLAP, LEAST = 600, 90, 50


def main_document(raw: Column) -> Column:
    """The longest ``<TEXT>`` of the first 10-K ``<DOCUMENT>``, else of all; texts without ``<TEXT>`` stay."""
    documents = F.filter(F.split(raw, "(?i)<DOCUMENT>"), lambda d: d.rlike("(?i)<TEXT>"))
    bodies = lambda docs: F.flatten(F.transform(docs, lambda d: F.regexp_extract_all(d, F.lit(r"(?is)<TEXT>(.*?)(?:</TEXT>|\z)"), F.lit(1))))
    annual = F.slice(F.filter(documents, lambda d: d.rlike(r"(?im)<TYPE>\s*10-K(?:/[^\s<]*)?\s*(?:$|<|\n)")), 1, 1)
    longest = lambda xs: F.element_at(F.array_sort(xs, lambda a, b: F.length(b) - F.length(a)), 1)
    pick = F.when(F.size(annual) > 0, bodies(annual)).otherwise(bodies(documents))
    return F.when(~raw.rlike("(?i)<TEXT>"), raw).otherwise(F.coalesce(F.regexp_replace(F.when(F.size(pick) > 0, longest(pick)), r"\A\s+|\s+\z", ""), raw))


def section_header(line: Column) -> Column:
    """The item that a line begins with, as it is written in the list; null for other lines.

    Any line that begins so is a heading, prose included.
    """
    numbers = sorted((s.split()[1] for s in SECTION_ITEMS), key=len, reverse=True)
    found = F.upper(F.regexp_extract(line, rf"(?i)^\s*(?:#+\s*)?item ({'|'.join(numbers)})\b", 1))
    return F.when(found != "", F.concat(F.lit("Item "), found))


def contents_row(line: Column) -> Column:
    """Rows of a table of contents that are no heading of the list."""
    return line.rlike(r"(?i)^\s*(#+\s*)?item\s+\d+[a-z]?(\.\d+)?\s*\.?\s*\|")


def sections(filings: DataFrame) -> DataFrame:
    """``company_ticker, fiscal_year, section_no, section_id, content``: the lines after each heading.

    ``filings(company_ticker, fiscal_year, text)``.  Blank lines, contents rows,
    what stands before the first heading, and headings without content go.  A
    filing is one row and stays in one task; its lines are folded in the order
    of their places.  A column ``filing`` keeps several filings of one pair
    apart, and stays.
    """
    keys = [c for c in ("company_ticker", "fiscal_year", "filing") if c in filings.columns]
    lines = filings.select(*keys, F.posexplode(F.split(F.translate("text", " ", " "), r"\r\n|\r|\n")).alias("place", "line")).filter(F.trim("line") != "")
    lines = lines.withColumn("header", section_header(F.trim("line")))
    lines = lines.filter(F.col("header").isNotNull() | ~contents_row(F.trim("line")))
    run = Window.partitionBy(*keys).orderBy("place")
    lines = lines.withColumn("section_no", F.count("header").over(run)).withColumn("section_id", F.last("header", ignorenulls=True).over(run))
    body = lines.filter("header IS NULL AND section_no > 0").groupBy(*keys, "section_no", "section_id")
    return body.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("content"))


def check_window(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")


def chunk_id(ticker: Column, year: Column, section: Column, page: Column, seq: Column, text: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", ticker, year.cast("string"), section, page.cast("string"), seq.cast("string"), text).cast("binary")), 1, 32)


def windows(rows: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Sliding windows of words over ``rows(..., company_ticker, fiscal_year, section_id, text)``.

    A text of at most ``size`` words is one window.  Windows of under ``least``
    words go, and numbers count the windows that stay.  Large tables are not shuffled.
    """
    return _windows(spread(rows), size, overlap, least)


def _windows(rows: DataFrame, size: int, overlap: int, least: int) -> DataFrame:
    check_window(size, overlap)
    n = F.size("toks")
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)))
    pieces = F.filter(F.transform(starts, lambda s: F.slice(F.col("toks"), s + 1, F.lit(size))), lambda p: F.size(p) >= least)
    out = rows.withColumn("toks", tokens(F.coalesce("text", F.lit("")))).withColumn("pieces", pieces).drop("text", "toks")
    out = out.select(*[c for c in out.columns if c != "pieces"], F.posexplode("pieces").alias("chunk_seq", "piece"))
    out = out.withColumn("text", F.array_join("piece", " ")).withColumn("token_count", F.size("piece").cast("bigint")).withColumn("chunk_seq", F.col("chunk_seq").cast("bigint")).drop("piece")
    return out.withColumn("chunk_id", chunk_id(F.col("company_ticker"), F.col("fiscal_year"), F.col("section_id"), F.lit(1), F.col("chunk_seq"), F.col("text")))


def is_table_row(line: str) -> bool:
    return " | " in line and line.count("|") >= 2


def table_aware(content: str, size: int = SIZE, least: int = LEAST) -> list[list[str]]:
    """Chunks of a section with tables, as lists of words.

    A table begins a new chunk and is cut only between rows, at ``size`` words.
    A closed table of under ``least`` words joins the prose after it.  Prose is
    cut between lines.  Pieces of under ``least`` words are dropped.
    """
    chunks: list[list[str]] = []
    prose: list[str] = []
    table: list[str] = []
    inside = False

    def emit(words: list[str]) -> None:
        if len(words) >= least:
            chunks.append(list(words))
        words.clear()

    for line in (content or "").splitlines():
        words = line.split()
        if is_table_row(line):
            if not inside:
                emit(prose)
                inside = True
            table += words
            if len(table) >= size:
                emit(table)
            continue
        if inside:
            if len(table) >= least:
                emit(table)
            else:
                prose += table
                table.clear()
            inside = False
        if prose and len(prose) + len(words) > size:
            emit(prose)
        prose += words
        if len(prose) >= size:
            emit(prose)
    emit(table)
    emit(prose)
    return chunks


def table_chunks(rows: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Chunks of ``rows(company_ticker, fiscal_year, section_id, content)``: by tables where a section has one, else by windows."""
    has_table = F.exists(F.split("content", "\n"), lambda x: x.contains(" | ") & (F.length(x) - F.length(F.replace(x, F.lit("|"))) >= 2))
    rows = spread(rows)
    plain = _windows(rows.filter(~has_table).withColumnRenamed("content", "text"), size, overlap, least)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(r.company_ticker, r.fiscal_year, r.section_id, i, " ".join(w), len(w)) for r in frame.itertuples() for i, w in enumerate(table_aware(r.content, size, least))]
            yield pd.DataFrame(out, columns=["company_ticker", "fiscal_year", "section_id", "chunk_seq", "text", "token_count"])

    keys = rows.select("company_ticker", "fiscal_year", "section_id", "content").filter(has_table)
    schema = "company_ticker string, fiscal_year bigint, section_id string, chunk_seq bigint, text string, token_count bigint"
    tables = keys.withColumn("fiscal_year", F.col("fiscal_year").cast("bigint")).mapInPandas(fold, schema)
    tables = tables.withColumn("chunk_id", chunk_id(F.col("company_ticker"), F.col("fiscal_year"), F.col("section_id"), F.lit(1), F.col("chunk_seq"), F.col("text")))
    return plain.select(tables.columns).unionByName(tables)


_BLOCK = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>")


def html_text(html: str | None) -> str:
    """Visible text: scripts and styles go, a table's rows become ``cell | cell``, other tags become line breaks."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.out: list[str] = []
            self.cells: list[str] | None = None
            self.cell: list[str] | None = None
            self.skip = 0

        def handle_starttag(self, tag, attrs) -> None:
            if tag in ("script", "style"):
                self.skip += 1
            elif tag == "tr":
                self.cells = []
            elif tag in ("td", "th") and self.cells is not None:
                self.cell = []

        def handle_endtag(self, tag) -> None:
            if tag in ("script", "style"):
                self.skip = max(0, self.skip - 1)
            elif tag in ("td", "th") and self.cell is not None:
                text = " ".join(" ".join(self.cell).split())
                if text and self.cells is not None:
                    self.cells.append(text)
                self.cell = None
            elif tag == "tr" and self.cells is not None:
                if self.cells:
                    self.out.append(" | ".join(self.cells))
                self.cells = None

        def handle_data(self, data) -> None:
            if self.skip:
                return
            if self.cell is not None:
                self.cell.append(data)
            elif self.cells is None and data.strip():
                self.out.append(data.strip())

    if not html:
        return ""
    low = html.lower()
    if "<table" not in low and "<a " not in low:
        return html
    reader = Reader()
    reader.feed(html)
    reader.close()
    return "\n".join(reader.out)


def clean_html(rows: DataFrame, column: str = "html") -> DataFrame:
    """``rows`` with ``content``, the visible text of ``column``, by batches."""
    schema = rows.drop(column).schema.add("content", "string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop(columns=column).assign(content=frame[column].map(html_text))

    return spread(rows).mapInPandas(run, schema)
