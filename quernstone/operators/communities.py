"""Communities by modularity, level by level, as joins and aggregations over the edges.

A level moves nodes to the community beside them that gains most, in rounds of
moves at the same time; then refines every community into parts that are
connected and well linked to it, starting from single nodes; then makes each
part a node of a smaller graph, whose nodes begin in the communities found.
It ends when a level moves nothing and merges nothing.

Moves at the same time can undo each other.  So the rounds take turns: one goes
to communities with smaller names only, the next to larger ones, and a state
that is not better than the last, by exact integers, is given up and tried
again with half of the movers, chosen by a checksum of their names.  Ties go to
the smallest name.  So the result depends on the edges and names alone,
whatever the partitioning.

Every round reads the edges once, sums weights before it shuffles them, and is
written to the shared folder.

Groups in which all nodes are linked with each other are not written out as
pairs: ``groups(group, node, n)`` says that a node stands in a group ``n`` times,
and two nodes of a group share 2 * n * m (an edge each way for each two).  What a
node shares with a community by a group follows from how often the community
stands in it.  The communities of a group that stand in it as often and are as
strong gain a node the same, so a round compares a node with such classes, and
takes the smallest name in the class; merged nodes stand in groups like others.
So a round's rows are the edges, and the members of groups times the classes
of their group.

A level of more rows than ``BROADCAST_ROWS`` joins by shuffles alone (``wide``):
Spark judges written tables by their compressed files, and would send many times
their size through the driver.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from quernstone.workspace import BROADCAST_ROWS, is_empty, materialize, shuffled

#: Rounds of a level, tries with fewer movers, rounds of a refinement, levels.
ROUNDS, TRIES, MERGES, LEVELS = 10, 2, 3, 12


def undirected(edges: DataFrame) -> DataFrame:
    """``a, b, w`` in both directions, with the number of ``edges(a, b)`` between two nodes; loops and null ends go."""
    pairs = edges.select("a", "b").dropna().filter("a <> b")
    return pairs.union(pairs.select("b", "a")).groupBy("a", "b").agg(F.count("*").alias("w"))


def _score(w: Column, k: Column, total: Column, mass: int, resolution: float) -> Column:
    """What a node of strength ``k`` gains in a community of strength ``total`` (without it) with which it shares ``w``."""
    return w.cast("double") - F.lit(float(resolution)) * k.cast("double") * total.cast("double") / F.lit(float(mass))


def _stands(groups: DataFrame, names: DataFrame, wide: bool) -> DataFrame:
    """``group, community, there``: how often each community stands in each group."""
    return groups.join(shuffled(names.select("node", "community"), wide), "node").groupBy("group", "community").agg(F.sum("n").alias("there"))


def _several(groups: DataFrame, names: DataFrame, wide: bool) -> DataFrame:
    """``node, community`` that may meet in several groups, as their weights are sums over these."""
    of = groups.join(shuffled(names.select("node", "community"), wide), "node").select("group", "node", "n", "community")
    many = of.groupBy("node").agg(F.count("*").alias("m")).filter("m > 1").select("node")
    met = of.select("group", "community").distinct()
    met = met.join(shuffled(met.groupBy("community").agg(F.count("*").alias("m")).filter("m > 1").select("community"), wide), "community")
    return of.select("group", "node").join(shuffled(many, wide), "node").join(shuffled(met, wide), "group").groupBy("node", "community").agg(F.count("*").alias("m")).filter("m > 1").select("node", "community")


def _weights(links: DataFrame, names: DataFrame, groups: DataFrame | None = None, several: bool = True, wide: bool = False, own: DataFrame | None = None) -> DataFrame:
    """``node, community, w``: what each node shares with each community beside it by ``links``, and a row for its own.

    Groups count, too; ``several`` says whether any node stands in more than one.
    With ``own``, a row for each node, its columns follow; it meets the groups first, so the rows are shuffled by node once.
    """
    beside = names.select(F.col("node").alias("b"), "community")
    near = links.join(shuffled(beside, wide), "b").select(F.col("a").alias("node"), "community", "w")
    none = F.lit(0).cast("long").alias("w")
    mine = names.select("node", "community", none)
    if groups is None:
        rows = near.unionByName(mine).groupBy("node", "community").agg(F.sum("w").alias("w"))
        return rows if own is None else rows.join(shuffled(own, wide), "node")
    rows = near.withColumn("mine", F.lit(False)).unionByName(mine.withColumn("mine", F.lit(True)))
    if several:
        rows = rows.unionByName(_several(groups, names, wide).select("node", "community", none, F.lit(False).alias("mine")))
    rows = rows.groupBy("node", "community").agg(F.sum("w").alias("w"), F.max("mine").alias("mine"))
    of, kept = groups.select("group", "node", "n"), []
    if own is not None:
        of, kept = own.join(shuffled(of, wide), "node", "left"), [c for c in own.columns if c != "node"]
    rows = rows.join(shuffled(of, wide), "node", "left" if own is None else "inner").join(shuffled(_stands(groups, names, wide), wide), ["group", "community"], "left")
    more = F.coalesce(2 * F.col("n") * (F.col("there") - F.when(F.col("mine"), F.col("n")).otherwise(0)), F.lit(0))
    if several:
        return rows.groupBy("node", "community").agg((F.first("w") + F.sum(more)).alias("w"), *(F.first(c).alias(c) for c in kept))
    return rows.select("node", "community", (F.col("w") + more).alias("w"), *kept)


def _state(links: DataFrame, names: DataFrame, groups: DataFrame | None = None, several: bool = True, wide: bool = False) -> DataFrame:
    """``_weights`` with the node's own community, strength and loops, from ``names(node, community, k, loop, moved)``."""
    own = names.select("node", F.col("community").alias("own"), "k", "loop", "moved")
    return _weights(links, names, groups, several, wide, own)


def _grouped(groups: DataFrame, names: DataFrame, totals: DataFrame, mass: int, resolution: float, upwards: bool, wide: bool) -> DataFrame:
    """``node, best(minus, to)``: the best community that each of ``names(node, community, k, asks)`` shares a group with, on one side of its own.

    A community that shares more than one group, or links, is worth more than
    this says; ``_weights`` has a row for it.
    """
    there = _stands(groups, names, wide).join(shuffled(totals.select("community", "total"), wide), "community")
    classes = there.groupBy("group", "there", "total").agg(F.min("community").alias("low"), F.max("community").alias("high"))
    asks = groups.join(shuffled(names.filter("asks").select("node", F.col("community").alias("own"), "k"), wide), "node")
    side = (F.col("high") > F.col("own")) if upwards else (F.col("low") < F.col("own"))
    rows = asks.join(shuffled(classes, wide), "group").filter(side).withColumn("minus", -_score(2 * F.col("n") * F.col("there"), F.col("k"), F.col("total"), mass, resolution))
    if upwards:
        # Of the best classes the next name after the node's own: names downwards, those who ask before an equal community.
        rows = rows.withColumn("least", F.min("minus").over(Window.partitionBy("node"))).filter("minus = least")
        rows = rows.select("group", "there", "total", F.col("own").alias("name"), F.lit(False).alias("has"), "node", "minus")
        has = there.select("group", "there", "total", F.col("community").alias("name"), F.lit(True).alias("has"), F.lit(None).alias("node"), F.lit(None).alias("minus"))
        passed = Window.partitionBy("group", "there", "total").orderBy(F.desc("name"), "has").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.unionByName(has).withColumn("low", F.last(F.when(F.col("has"), F.col("name")), ignorenulls=True).over(passed)).filter("NOT has")
    return rows.groupBy("node").agg(F.min(F.struct("minus", F.col("low").alias("to"))).alias("best"))


_MINE = "community = own"


def _value(state: DataFrame, mass: int, resolution: float) -> tuple[Fraction, int]:
    """Modularity times ``mass`` squared, exactly, and how many nodes moved."""
    each = state.filter(_MINE).groupBy("community").agg(F.sum("k").cast("decimal(19,0)").alias("k"), F.sum(F.col("w") + F.col("loop")).alias("inner"), F.sum(F.col("moved").cast("long")).alias("moved"))
    row = each.agg(F.sum(F.col("k") * F.col("k")).cast("decimal(38,0)").alias("k2"), F.sum(F.col("inner").cast("decimal(38,0)")).alias("inner"), F.sum("moved").alias("moved")).head()
    return mass * int(row["inner"] or 0) - Fraction(resolution) * int(row["k2"] or 0), row["moved"] or 0


def _moves(state: DataFrame, mass: int, resolution: float, upwards: bool, part: int, turn: int, groups: DataFrame | None = None, wide: bool = False) -> DataFrame:
    """``node, community, k, loop, moved`` after a round of moves."""
    totals = state.filter(_MINE).groupBy("community").agg(F.sum("k").alias("total"))
    mine = F.expr(_MINE)
    rows = state.join(shuffled(totals, wide), "community").withColumn("score", _score(F.col("w"), F.col("k"), F.col("total") - F.when(mine, F.col("k")).otherwise(0), mass, resolution))
    right = (F.col("community") > F.col("own")) if upwards else (F.col("community") < F.col("own"))
    best = F.when(right, F.struct((-F.col("score")).alias("minus"), F.col("community").alias("to")))
    rows = rows.select("node", "own", "k", "loop", F.when(mine, F.col("score")).alias("stay"), best.alias("best"))
    if groups is not None:
        names = state.filter(_MINE).select("node", "community", "k", F.lit(True).alias("asks"))
        rows = rows.unionByName(_grouped(groups, names, totals, mass, resolution, upwards, wide), allowMissingColumns=True)
    first = (F.first(c, ignorenulls=True).alias(c) for c in ("own", "k", "loop"))
    out = rows.groupBy("node").agg(*first, F.max("stay").alias("stay"), F.min("best").alias("best"))
    active = F.pmod(F.crc32(F.concat_ws("|", "node", F.lit(str(turn))).cast("binary")), F.lit(part)) == 0
    goes = F.coalesce(-F.col("best.minus") > F.col("stay"), F.lit(False)) & active
    return out.select("node", F.when(goes, F.col("best.to")).otherwise(F.col("own")).alias("community"), "k", "loop", goes.alias("moved"))


def move(links: DataFrame, names: DataFrame, mass: int, resolution: float, groups: DataFrame | None = None, several: bool = True, wide: bool = False) -> tuple[DataFrame, bool]:
    """``names(node, community, k, loop)`` after the rounds of a level, and whether any node has moved."""
    state = materialize(_state(links, names.withColumn("moved", F.lit(False)), groups, several, wide), "state")
    (value, _), any_, still, turn = _value(state, mass, resolution), False, 0, 0
    while still < 2 and turn < ROUNDS:
        turn += 1
        still += 1
        for half in range(TRIES):
            moves = _moves(state, mass, resolution, turn % 2 == 0, 1 << half, turn, groups, wide)
            after = materialize(_state(links, moves if groups is None else materialize(moves, "moves"), groups, several, wide), "state")
            better, moved = _value(after, mass, resolution)
            if moved and better > value:
                state, value, any_, still = after, better, True, 0
            if not moved or not still:
                break
    return state.filter(_MINE).select("node", "community", "k", "loop"), any_


def refine(links: DataFrame, names: DataFrame, mass: int, resolution: float, groups: DataFrame | None = None, several: bool = True, wide: bool = False) -> DataFrame:
    """``node, part``: each community cut into connected parts, named by a node of theirs.

    A single node joins the part of its community that gains most, with a smaller
    name, if the node is well linked to the community and the part stays where it is.
    """
    inside = names.select("node", F.col("community").alias("of"), "k")
    ends = links.join(shuffled(inside.select(F.col("node").alias("a"), F.col("of").alias("x")), wide), "a").join(shuffled(inside.select(F.col("node").alias("b"), F.col("of").alias("y")), wide), "b")
    inner = materialize(ends.filter("x = y").select("a", "b", "w"), "inner")
    shared = inner.select(F.col("a").alias("node"), "w")
    if groups is not None:
        of = groups.join(shuffled(inside.select("node", "of"), wide), "node").select(F.struct("group", "of").alias("group"), "node", "n")
        groups = materialize(_linking(of, wide), "inner_groups")
        shared = shared.union(_strengths(groups))
    within = shared.groupBy("node").agg(F.sum("w").alias("within"))
    whole = inside.groupBy("of").agg(F.sum("k").alias("whole"))
    linked = inside.join(shuffled(within, wide), "node").join(shuffled(whole, wide), "of").filter(_score(F.col("within"), F.col("k"), F.col("whole") - F.col("k"), mass, resolution) >= 0).select("node")
    parts = materialize(inside.select("node", F.col("node").alias("community"), "k"), "parts")
    linked = materialize(linked, "linked")
    for _ in range(MERGES):
        size = parts.groupBy("community").agg(F.sum("k").alias("total"), F.count("*").alias("n"))
        single = size.filter("n = 1").select(F.col("community").alias("node")).join(shuffled(linked, wide), "node", "left_semi")
        rows = _weights(inner, parts, groups, several, wide).join(shuffled(single, wide), "node", "left_semi").join(shuffled(parts.select("node", "k"), wide), "node").join(shuffled(size, wide), "community").filter("community < node AND w > 0")
        rows = rows.withColumn("score", _score(F.col("w"), F.col("k"), F.col("total"), mass, resolution)).filter("score > 0")
        rows = rows.select("node", F.struct((-F.col("score")).alias("minus"), F.col("community").alias("to")).alias("best"))
        if groups is not None:
            names = parts.join(shuffled(single.withColumn("asks", F.lit(True)), wide), "node", "left").select("node", "community", "k", F.coalesce("asks", F.lit(False)).alias("asks"))
            rows = rows.union(_grouped(groups, names, size, mass, resolution, False, wide).filter("best.minus < 0"))
        goes = materialize(rows.groupBy("node").agg(F.min("best").alias("best")).select("node", F.col("best.to").alias("to")), "goes")
        stays = goes.join(shuffled(goes.select(F.col("node").alias("to")), wide), "to", "left_anti")
        parts = materialize(parts.join(shuffled(stays, wide), "node", "left").select("node", F.coalesce("to", "community").alias("community"), "k"), "parts")
        if not goes.limit(1).count():
            break
    return parts.select("node", F.col("community").alias("part"))


def _linking(groups: DataFrame, wide: bool) -> DataFrame:
    """``group, node, n, others`` (how often all others stand there) of the groups that link any two nodes."""
    whole = groups.groupBy("group").agg(F.sum("n").alias("whole"))
    return groups.join(shuffled(whole, wide), "group").select("group", "node", "n", (F.col("whole") - F.col("n")).alias("others")).filter("others > 0")


def _crossing(groups: DataFrame | None) -> tuple[DataFrame | None, bool]:
    """Written groups, or none if they link nothing, and whether a node stands in several."""
    if groups is None or is_empty(groups):
        return None, False
    return groups, not is_empty(groups.groupBy("node").agg(F.count("*").alias("m")).filter("m > 1"))


def _strengths(groups: DataFrame) -> DataFrame:
    """``node, w``: what each node shares with all others of a group."""
    return groups.select("node", (2 * F.col("n") * F.col("others")).alias("w"))


def _merged(groups: DataFrame, parts: DataFrame, wide: bool) -> tuple[DataFrame, DataFrame]:
    """The groups of ``parts(node, part)``, and ``node, more``: what nodes of a part share with each other by groups."""
    each = groups.join(shuffled(parts, wide), "node").groupBy("group", F.col("part").alias("node")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    each = materialize(each, "groups")
    loops = each.select("node", (2 * (F.col("n") * F.col("n") - F.col("squares"))).alias("more")).filter("more > 0")
    return materialize(_linking(each.select("group", "node", "n"), wide), "linking"), loops


def modular(edges: DataFrame, resolution: float = 1.0, groups: DataFrame | None = None) -> DataFrame:
    """``node, community`` of undirected ``edges(a, b)``; a community is named by its smallest node.

    ``groups(group, node, n)``, a row for each node of a group, stands for edges
    both ways between all of a group that are different nodes.

    Repeated edges weigh as often as they occur; loops and edges with a null end
    are left out; nodes without an edge are in no community.  A larger
    ``resolution`` makes smaller communities.
    """
    links = materialize(undirected(edges), "links")
    shared = links.select(F.col("a").alias("node"), "w")
    if groups is not None:
        groups = materialize(_linking(groups.dropna(), True), "linking")  # not counted yet
        shared = shared.union(_strengths(groups))
    strength = shared.groupBy("node").agg(F.sum("w").alias("k"))
    names = materialize(strength.select("node", F.col("node").alias("community"), "k", F.lit(0).cast("long").alias("loop")), "names")
    mass = names.agg(F.sum("k")).head()[0] or 0
    at, wide = names.select("node", F.col("node").alias("at")), False
    for _ in range(LEVELS):
        if not mass:
            break
        groups, several = _crossing(groups)
        wide = sum(t.count() for t in (links, names, groups) if t is not None) > BROADCAST_ROWS
        names, moved = move(links, names, mass, resolution, groups, several, wide)
        if not moved:
            break
        parts = materialize(refine(links, names, mass, resolution, groups, several, wide), "refined")
        at = materialize(at.join(shuffled(parts.withColumnRenamed("node", "at"), wide), "at").select("node", F.col("part").alias("at")), "at")
        ends = links.join(shuffled(parts.select(F.col("node").alias("a"), F.col("part").alias("x")), wide), "a").join(shuffled(parts.select(F.col("node").alias("b"), F.col("part").alias("y")), wide), "b")
        merged = materialize(ends.groupBy("x", "y").agg(F.sum("w").alias("w")), "merged")
        loops = merged.filter("x = y").select(F.col("x").alias("node"), F.col("w").alias("more"))
        if groups is not None:
            groups, more = _merged(groups, parts, wide)
            loops = loops.union(more).groupBy("node").agg(F.sum("more").alias("more"))
        named = names.join(shuffled(parts, wide), "node").groupBy(F.col("part").alias("node")).agg(F.min("community").alias("community"), F.sum("k").alias("k"), F.sum("loop").alias("loop"))
        named = named.join(shuffled(loops, wide), "node", "left").select("node", "community", "k", (F.col("loop") + F.coalesce("more", F.lit(0))).alias("loop"))
        names = materialize(named, "names")
        links = merged.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"), "w")
    out = at.join(shuffled(names.select(F.col("node").alias("at"), "community"), wide), "at").select("node", "community")
    named = out.groupBy("community").agg(F.min("node").alias("least"))
    return out.join(shuffled(named, wide), "community").select("node", F.col("least").alias("community"))


def modularity(edges: DataFrame, names: DataFrame, resolution: float = 1.0, groups: DataFrame | None = None) -> float:
    """How many more edges lie within the communities of ``names(node, community)`` than by chance, as a part of all."""
    links = undirected(edges)
    shared = links.select(F.col("a").alias("node"), "w")
    if groups is not None:
        groups = _linking(groups.dropna(), True)
        shared = shared.union(_strengths(groups))
    mass = shared.agg(F.sum("w")).head()[0]
    if not mass:
        return 0.0
    strength = shared.groupBy("node").agg(F.sum("w").alias("k"))
    known = names.join(shuffled(strength, True), "node").select("node", "community", "k", F.lit(0).cast("long").alias("loop"), F.lit(False).alias("moved"))
    return float(_value(_state(links, known, groups, wide=True), mass, resolution)[0] / mass**2)
