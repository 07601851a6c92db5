"""Model output to typed triplets.

The model is a hook: any column of JSON-like text will do.  Parsing is tolerant
and runs in Arrow batches; typing and filtering are column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import suppress
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quernstone.functions.scalars import entity_key
from quernstone.functions.tables import RELATIONS, YEAR

#: A string, with its end as a group; a bracket; what stands between them.
_TOKEN = re.compile(r'(?s)"(?:[^"\\]|\\.?)*+("?)|[{}\[\]]|[^"{}\[\]]+')
_SPANS = tuple(re.compile(p) for p in (r"(?s)\S.*", r"(?s)\{.*\}", r"(?s)\[.*\]"))
_THINKING = re.compile(r"(?is)<think>.*?(?:</think>|\Z)")
_FENCE = re.compile(r"(?s)```(?:json)?\s*(.*?)```")
#: Characters of a text that a single and a batched extraction send to a model.
SINGLE_CHARS, BATCH_CHARS = 4000, 1900
_KEPT = ("value", "unit", "fiscal_year", "year")


def unwrapped(text: str) -> str:
    """What a model said, without its thinking and the fence around it."""
    text = _THINKING.sub("", text or "")
    fenced = _FENCE.search(text)
    return (fenced.group(1) if fenced else text).strip()


def repaired(text: str) -> str:
    """``text`` with each ``{"x"}`` as ``{"name": "x"}`` and with what is open at its end closed; JSON stays as it is."""
    pieces, open_ = [], []
    for token in _TOKEN.finditer(text):
        piece = token[0]
        if piece in ("{", "["):
            open_.append(len(pieces))
        elif piece in ("}", "]") and open_:
            start = open_.pop()
            # A lone name has white space around it at most.
            inside = [i for i in range(start + 1, len(pieces)) if pieces[i].strip()] if len(pieces) - start <= 4 else []
            if piece == "}" and pieces[start] == "{" and len(inside) == 1 and pieces[inside[0]][0] == '"':
                pieces[inside[0]] = '"name": ' + pieces[inside[0]]
        pieces.append(piece + '"' if token[1] == "" else piece)
    return "".join(pieces) + "".join("}" if pieces[at] == "{" else "]" for at in reversed(open_))


def json_within(text: str) -> Any:
    """The JSON that ``text`` is, or that its widest braces or brackets hold, repaired; None where there is none or it nests too deep to be read."""
    for span in _SPANS:
        if found := span.search(text.strip()):
            with suppress(ValueError, RecursionError):
                return json.loads(repaired(found[0]))
    return None


def _entity(raw: Any) -> dict[str, str]:
    if isinstance(raw, dict):
        props = {k: str(v).strip() for k, v in raw.items() if v not in (None, "") and not isinstance(v, (dict, list))}
        for k in _KEPT:
            if isinstance(raw.get("properties"), dict) and raw["properties"].get(k) not in (None, ""):
                props.setdefault(k, str(raw["properties"][k]).strip())
        return props
    return {"name": str(raw).strip()} if raw not in (None, "") and not isinstance(raw, list) else {}


def triplet(raw: Any) -> tuple[dict, str, dict] | None:
    """Source, relation and target of one triplet in any known shape; None if it is invalid."""
    if isinstance(raw, list):
        source, relation, target = raw[:3] if len(raw) >= 3 else (None, None, None)
    elif isinstance(raw, dict):
        source, target = (raw.get(f"{side}_entity") or raw.get(side) for side in ("source", "target"))
        relation = raw.get("relation")
    else:
        return None
    source, target = _entity(source), _entity(target)
    known = {r.lower() for r, _, _ in RELATIONS}
    if not isinstance(relation, str) or relation.strip().lower() not in known or not source.get("name") or not target.get("name"):
        return None
    return source, relation.strip().lower(), target


def by_chunk(data: Any, chunk_id: str | None = None) -> dict[str | None, list]:
    """Raw triplets by chunk: ``results`` lists, mappings from chunks, lists of entries, or one chunk's own."""
    if isinstance(data, dict) and isinstance(data.get("results"), list):
        data = data["results"]
    if isinstance(data, list):
        entries = [x for x in data if isinstance(x, dict) and ("triplets" in x or "triples" in x)]
        if entries:
            named = ((x.get("chunk_id") or x.get("id") or x.get("chunkId"), x.get("triplets", x.get("triples"))) for x in entries)
            return {str(k): v for k, v in named if k and isinstance(v, list)}
        return {chunk_id: data}
    if isinstance(data, dict):
        own = data.get("triplets", data.get("triples"))
        if isinstance(own, list):
            return {chunk_id: own}
        if "relation" in data:
            return {chunk_id: [data]}
        return {str(k): (v["triplets"] if isinstance(v, dict) else v) for k, v in data.items() if isinstance(v, list) or isinstance(v, dict) and isinstance(v.get("triplets"), list)}
    return {}


def parse(rows: DataFrame, column: str = "output") -> DataFrame:
    """``chunk_id, relation, source, source_props, target, target_props`` of ``rows(chunk_id, output)``; invalid triplets go one by one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for chunk, text in zip(frame["chunk_id"], frame[column]):
                for own, raws in by_chunk(json_within(unwrapped(text)), chunk).items():
                    for found in map(triplet, raws):
                        if found:
                            s, r, t = found
                            out.append((own if own is not None else chunk, r, s["name"], {k: v for k, v in s.items() if k != "name"}, t["name"], {k: v for k, v in t.items() if k != "name"}))
            yield pd.DataFrame(out, columns=["chunk_id", "relation", "source", "source_props", "target", "target_props"])

    schema = "chunk_id string, relation string, source string, source_props map<string,string>, target string, target_props map<string,string>"
    return rows.select(F.col("chunk_id").cast("string").alias("chunk_id"), column).mapInPandas(run, schema)


def label_of(relation: Column, side: int) -> Column:
    """The label of a relation's source (0) or target (1); Company for unknown relations."""
    labels = F.create_map(*[F.lit(x) for r in RELATIONS for x in (r[0].lower(), r[1 + side])])
    return F.coalesce(F.element_at(labels, relation), F.lit("Company"))


def typed(parsed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Triplets with labels and primary keys, ready for the graph.

    Joined with ``chunks(chunk_id, company_ticker, fiscal_year, text)``; triplets
    without a valid end, and those from a node to itself, go.  A metric without
    a year gets the last one before its value in the text (where ``chunks`` has
    it), else the filing's.  The names are the ends as the output has them.
    """
    text = F.col("text") if "text" in chunks.columns else F.lit(None).cast("string")
    rows = parsed.join(chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "company_ticker", "fiscal_year", text.alias("text")), "chunk_id")
    out = rows.withColumns({"src_label": label_of(F.col("relation"), 0), "dst_label": label_of(F.col("relation"), 1)})
    for end, side in (("src", "source"), ("dst", "target")):
        props = F.col(f"{side}_props")
        said = F.substring(F.trim(F.coalesce(props["year"], props["fiscal_year"])), 1, 4).try_cast("bigint")
        if side == "target":
            near = metric_year(F.col("text"), props["value"], F.col(side))
            unsaid = F.coalesce(props["year"], props["fiscal_year"], F.lit("")) == ""
            said = F.when(unsaid & F.lower("relation").isin("reported_metric", "impacts_revenue"), near).otherwise(said)
        year = F.when(said.between(2015, 2030), said).otherwise(F.col("fiscal_year").cast("bigint"))
        out = out.withColumn(end, entity_key(F.col(side), F.col(f"{end}_label"), F.col("company_ticker"), year))
    out = out.filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & ~((F.col("src_label") == F.col("dst_label")) & (F.col("src") == F.col("dst"))))
    return out.select("chunk_id", F.upper("relation").alias("rel"), "src_label", "src", F.trim("source").alias("src_name"), "source_props", "dst_label", "dst", F.trim("target").alias("dst_name"), "target_props").dropDuplicates(["chunk_id", "rel", "src_label", "src", "dst_label", "dst"])


def metric_year(text: Column, value: Column, name: Column, reach: int = 400) -> Column:
    """The last year that begins less than ``reach`` characters before a metric's value, or before its name where the value isn't found.

    Null without a value, without either in the text, and without a year.
    """
    digits = F.substring(F.regexp_replace(value, "[^0-9]", ""), 1, 6)
    by_value, by_name = F.when(digits != "", F.instr(text, digits)).otherwise(0), F.instr(F.lower(text), F.lower(F.coalesce(name, F.lit(""))))
    at = F.when(by_value > 0, by_value).otherwise(by_name)
    # A character before and one after: the year neither begins further off nor where the value does.
    low = F.greatest(at + 1 - reach, F.lit(1))
    window = F.substring(F.concat(F.lit(" "), text, F.lit(" ")), low, at + 5 - low)
    found = F.regexp_extract_all(window, F.lit(rf"(?<=[\s\S])({YEAR})(?=[\s\S])"), F.lit(1))
    return F.when((F.coalesce(value, F.lit("")) != "") & (at > 0), F.try_element_at(found, F.lit(-1))).cast("bigint")


def after_json(text: str, least: int = 20) -> str:
    """``text`` without a leading JSON object, if more than ``least`` characters of prose follow."""
    body = (text or "").lstrip()
    if not body.startswith("{"):
        return text
    depth = 0
    for token in _TOKEN.finditer(body):
        depth += (token[0] == "{") - (token[0] == "}")
        if not depth:
            rest = body[token.end() :].lstrip()
            return rest if len(rest) > least else text
    return text
