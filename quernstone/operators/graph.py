"""A typed property graph as DataFrames.

Nodes are ``nodes(label, key, seq, props)`` and edges ``edges(rel, src_label,
src, dst_label, dst)``.  Properties are a map, so one that no column knows is
kept.  All limits have a total order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quernstone.functions.scalars import noise_name, noisy_company
from quernstone.functions.tables import LABELS, MENTIONS, QUERY_ALIASES, RELATIONS
from quernstone.operators.names import NameIndex, build_names, containing, starts
from quernstone.operators.retrieval import top
from quernstone.workspace import is_empty, materialize


def merge_last(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row for each key with, in every other column, the last non-null value by ``seq``."""
    values = [c for c in rows.columns if c not in (*keys, seq)]
    return rows.groupBy(*keys).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in values))


def merge_rows(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row for each key: its last row by ``seq``, nulls included."""
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), seq).alias("_row")).select(*keys, *(F.col("_row")[c].alias(c) for c in values if c != seq))


def merge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct edges whose two ends exist."""
    src = nodes.select(F.col("label").alias("src_label"), F.col("key").alias("src"))
    dst = nodes.select(F.col("label").alias("dst_label"), F.col("key").alias("dst"))
    return edges.distinct().join(src, ["src_label", "src"], "left_semi").join(dst, ["dst_label", "dst"], "left_semi").select("rel", "src_label", "src", "dst_label", "dst")


def typed_edges(triplets: DataFrame) -> DataFrame:
    """Edges of ``triplets(rel, src, dst)`` with the labels that the relation has."""
    labels = F.create_map(*[x for r, s, d in RELATIONS for x in (F.lit(r), F.struct(F.lit(s).alias("s"), F.lit(d).alias("d")))])
    out = triplets.withColumn("_l", F.element_at(labels, F.col("rel"))).filter("_l IS NOT NULL")
    return out.select("rel", F.col("_l.s").alias("src_label"), "src", F.col("_l.d").alias("dst_label"), "dst")


def mentions(triplets: DataFrame) -> DataFrame:
    """``rel, chunk_id, label, key``: each chunk with both ends of its triplets ``(chunk_id, src_label, src, dst_label, dst)``."""
    return ends(triplets).distinct()


def ends(triplets: DataFrame) -> DataFrame:
    """``mentions`` as often as triplets have them."""
    rels = F.create_map(*[F.lit(x) for kv in MENTIONS.items() for x in kv])
    both = F.array(F.struct(F.col("src_label").alias("label"), F.col("src").alias("key")), F.struct(F.col("dst_label").alias("label"), F.col("dst").alias("key")))
    rows = triplets.select("chunk_id", F.explode(both).alias("end")).filter("end.key IS NOT NULL")
    return rows.select(F.element_at(rels, F.col("end.label")).alias("rel"), "chunk_id", "end.label", "end.key")


def find_entities(nodes: DataFrame, candidates: DataFrame, aliases: dict[str, str] = QUERY_ALIASES, index: NameIndex | None = None) -> DataFrame:
    """``query_id, candidate, label, key``: for each candidate and label the best node.

    ``nodes(label, key[, name])``, ``candidates(query_id, candidate)``; without
    names, keys are the names.  Companies match by key, the candidate's or that of
    the company it is an alias of; then all match by lower-cased name, then by
    part of the name; ties go to the smallest key.  The first two are equi-joins;
    the last looks up trigrams in ``index``, or in one made of the candidates that
    the others left open.  An empty candidate is part of no name.
    """
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    asked = candidates.withColumns({"low": F.lower("candidate"), "exact": F.coalesce(F.element_at(known, F.lower("candidate")), F.col("candidate"))})
    if "name" not in nodes.columns:
        nodes = nodes.withColumn("name", F.col("key"))
    out = ["query_id", "candidate", "label", "key"]
    own = asked.join(nodes.filter("label = 'Company'"), F.col("exact") == F.col("key")).select(*out, F.lit(0).alias("tier"))
    same = asked.join(nodes.select("label", "key", F.lower("name").alias("low")), "low").select(*out, F.lit(1).alias("tier"))
    met = top(own.union(same), ["query_id", "candidate", "label"], [F.asc("tier"), F.asc("key")], 1).select(out)
    met = materialize(met, "met")
    open_ = asked.select("query_id", "candidate", "low", F.explode(F.array(*map(F.lit, LABELS))).alias("label"))
    open_ = materialize(open_.join(met.select("query_id", "candidate", "label"), ["query_id", "candidate", "label"], "left_anti"), "open_candidates")
    texts = open_.select("low").distinct()
    found = containing(index or build_names(nodes, only=starts(texts)), texts)
    inside = open_.join(found, ["low", "label"]).select(*out)
    return met.union(top(inside, ["query_id", "candidate", "label"], [F.asc("key")], 1).select(out))


def hops(edges: DataFrame | Callable[[DataFrame], DataFrame], starts: DataFrame, max_hops: int = 3, fan_out: int = 50, most: int | None = None) -> DataFrame:
    """``query_id, label, key, depth``: the smallest depth (start 1) of nodes within ``max_hops`` of the starts.

    Edges are followed in their direction, at most ``fan_out`` for each node and
    relation, smallest targets first.  Each hop reads only the edges of the nodes
    that the last one reached, and is written, so that its size is known; nodes
    that were reached before do not move again.  ``edges`` may be a function from
    nodes ``(src_label, src)`` to their edges, which then need not all exist.  With
    ``most``, a question visits so many nodes at most: the nearest, of those at one
    depth the first by label and key.
    """

    def within(front: DataFrame, seen: DataFrame | None) -> DataFrame:
        if most is None:
            return front
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("label", "key"))
        front = front.withColumn("_place", place)
        if seen is not None:
            front = front.join(seen.groupBy("query_id").agg(F.count("*").alias("_seen")), "query_id", "left")
        left = most - (F.lit(0) if seen is None else F.coalesce("_seen", F.lit(0)))
        return front.filter(F.col("_place") <= left).drop("_place", "_seen")

    ends = ["src_label", "src"]
    seen = front = materialize(within(starts.select("query_id", "label", "key", F.lit(1).cast("bigint").alias("depth")).distinct(), None), "hop_1")
    for depth in range(2, max_hops + 1):
        at = front.select(F.col("label").alias("src_label"), F.col("key").alias("src"))
        near = edges(at.distinct()) if callable(edges) else edges.join(at.distinct(), ends, "left_semi")
        own = near.select("rel", *ends, "dst_label", "dst").distinct()
        moves = top(own, ["rel", *ends], [F.asc("dst")], fan_out).select(*ends, "dst_label", "dst")
        step = front.select("query_id", F.col("label").alias("src_label"), F.col("key").alias("src")).join(moves, ends)
        step = step.select("query_id", F.col("dst_label").alias("label"), F.col("dst").alias("key")).distinct()
        front = within(step.join(seen, ["query_id", "label", "key"], "left_anti"), seen).withColumn("depth", F.lit(depth).cast("bigint"))
        front = materialize(front.select(seen.columns), f"hop_{depth}")
        seen = seen.unionByName(front)
    return seen


def traverse(reached: DataFrame, cited: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, chunk_id, score, rank``: chunks that mention reached nodes, by 1 / smallest depth.

    Repeated rows of ``cited(label, key, chunk_id)`` change nothing.
    """
    scored = reached.join(cited, ["label", "key"]).groupBy("query_id", "chunk_id").agg((1.0 / F.min("depth")).alias("score"))
    return top(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def facts(edges: DataFrame, companies: DataFrame, per_entity: int = 10, k: int = 20) -> DataFrame:
    """``query_id, fact``: segments and competitors of the companies as ``S --R--> O``, without noise, the first ``k`` in order."""
    rows = edges.filter(F.col("rel").isin("OPERATES_IN", "COMPETES_WITH")).join(companies.select("query_id", F.col("key").alias("src")), "src")
    rows = rows.filter(~noise_name(F.col("src")) & ~noise_name(F.col("dst"))).select("query_id", "rel", "src", "dst").distinct()
    rows = top(rows, ["query_id", "rel", "src"], [F.asc("dst")], per_entity)
    text = F.concat("src", F.lit(" --"), "rel", F.lit("--> "), "dst").alias("fact")
    return top(rows.select("query_id", text).distinct(), ["query_id"], [F.asc("fact")], k).select("query_id", "fact")


def metric_rows(metrics: DataFrame, cited: DataFrame, tickers: list[str], years: list[int] | None = None, k: int = 20) -> DataFrame:
    """Metrics with a composite id of some companies (and years), each with its first citing chunk.

    ``metrics(metric_id, ticker, fiscal_year, name, value, unit)``,
    ``cited(metric_id, chunk_id)``; by ticker, year and id.
    """
    rows = metrics.filter(F.col("metric_id").contains("_") & F.col("ticker").isin(*tickers))
    rows = rows if not years else rows.filter(F.col("fiscal_year").isin(*years))
    rows = rows.orderBy("ticker", "fiscal_year", "metric_id").limit(k)
    first = cited.join(rows.select("metric_id"), "metric_id", "left_semi").groupBy("metric_id").agg(F.min("chunk_id").alias("chunk_id"))
    return rows.join(first, "metric_id", "left")


def markdown_table(rows: DataFrame, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """One row, ``block``, or one for each value of ``by``: the metric rows as a Markdown table whose rule has as many cells as its header."""
    shown = F.trim(F.concat_ws(" ", "value", "unit"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "ticker", F.col("fiscal_year").cast("string"), "name", F.when(shown == "", "(no value extracted)").otherwise(shown), F.coalesce("section_id", F.lit("Item 8")), F.coalesce("chunk_id", F.lit(""))), F.lit(" |"))
    body = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("rows"))
    head = "| ticker | year | metric | value | section | chunk_id |\n|---|---|---|---|---|---|"
    return body.filter(F.size("rows") > 0).select(*by, F.concat_ws("\n", F.lit(head), F.array_join(F.col("rows.line"), "\n")).alias("block"))


def connected(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that undirected ``edges(a, b)`` reach.

    Smallest neighbour, then pointer jumping, until nothing changes; each round
    is written to the shared folder.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "both")
    names = materialize(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "names")
    while True:
        near = both.join(names.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = names.join(near, "node").select("node", F.least("component", "near").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
        step = step.join(jump, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        step = materialize(step, "names")
        changed = step.join(names.withColumnRenamed("component", "was"), "node").filter("component <> was")
        done = is_empty(changed)
        names = step
        if done:
            return names


def propagate_labels(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``node, community`` by weighted label propagation over undirected ``edges(a, b)``.

    A stand-in for modularity communities: in each round a node takes the label
    that most of its neighbours (and itself) hold, the smallest on a tie.
    """
    pairs = edges.filter("a <> b").select("a", "b")
    both = materialize(pairs.union(pairs.select("b", "a")).groupBy("a", "b").agg(F.count("*").alias("w")), "both")
    names = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(names.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "community", "w").unionByName(names.withColumn("w", F.lit(1).cast("long")))
        sums = votes.groupBy("node", "community").agg(F.sum("w").alias("w"))
        names = materialize(sums.groupBy("node").agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("community")), "names")
    return names


def summaries(names: DataFrame, edges: DataFrame, k: int = 20, shown: int = 5) -> DataFrame:
    """The largest communities: size, first members, inner edges and a template summary (where a model may write one)."""
    size = names.groupBy("community").agg(F.count("*").alias("size"))
    large = size.orderBy(F.desc("size"), F.asc("community")).limit(k)
    first = top(names, ["community"], [F.asc("node")], shown).groupBy("community").agg(F.array_sort(F.collect_list("node")).alias("top_entities"))
    large = large.join(first, "community")
    a, b = names.select(F.col("node").alias("a"), F.col("community").alias("ca")), names.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    inner = edges.join(a, "a").join(b, "b").filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("n_edges"))
    out = large.join(inner, "community", "left").fillna(0, ["n_edges"])
    text = F.concat(F.lit("Community of "), F.col("size").cast("string"), F.lit(": "), F.array_join("top_entities", ", "))
    return out.select("community", "size", F.array_join("top_entities", ", ").alias("top_entities"), "n_edges", text.alias("summary"))


def details(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """``name, type`` of the nodes ``(label, key)`` whose key is one of ``names(name)``; a name may have several labels."""
    return nodes.join(names.select(F.col("name").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("name"), F.col("label").alias("type")).distinct()


def drop_noisy(nodes: DataFrame) -> DataFrame:
    """Nodes without companies that are none."""
    return nodes.filter(~((F.col("label") == "Company") & noisy_company(F.col("key"))))


def union_nodes(tables: dict[str, DataFrame]) -> DataFrame:
    """``label, key`` of several node tables, whose first column is the key."""
    parts = [df.select(F.lit(label).alias("label"), F.col(df.columns[0]).cast("string").alias("key")) for label, df in tables.items() if label in LABELS]
    return reduce(DataFrame.unionByName, parts)


def keyed(label: str, key: Column) -> list[Column]:
    return [F.lit(label).alias("label"), key.cast("string").alias("key")]
