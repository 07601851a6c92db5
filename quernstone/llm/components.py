"""Connected components by random contraction, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quernstone.workspace import materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, root)``; ``root`` is a node of the component.

    The nodes are taken to be well-mixed 64-bit hashes.  In each round every
    node moves to the smallest node beside it, the edges are renamed, and loops
    and repeats go; with random labels the rounds follow the logarithm of the
    size.  Each round's tables are written to the shared folder.  Null ends are
    dropped; no edges give no rows.
    """
    left = materialize(edges.select("a", "b").dropna().filter("a <> b").distinct(), "edges", edges.count())
    jumps: list[DataFrame] = []
    while n := left.count():
        both = left.union(left.select("b", "a"))
        step = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to")), "step", 2 * n)
        hop = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = materialize(step.join(hop, "to").select("node", F.col("next").alias("to")), "jump", 2 * n)
        jumps.append(step)
        at, bt = step.select(F.col("node").alias("a"), F.col("to").alias("x")), step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        left = left.join(at, "a").join(bt, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left = materialize(left, "edges", n)
    if not jumps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    names = jumps[0].withColumnRenamed("to", "root")
    for step in jumps[1:]:
        after = step.select(F.col("node").alias("root"), "to")
        names = names.join(after, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(names, "names", jumps[0].count())
