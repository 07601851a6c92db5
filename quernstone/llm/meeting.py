"""Where members with a common signature meet: shared by the signature joins.

Signatures travel as packed arrays, a row for each bucket and flush, so the
shuffle moves bytes, not rows.  Groups of the same members, whatever their
signatures, count once.  A group gives only the pairs with its most connected
member at first (the one that is in the most groups: of a family of copies, its
original).  After these are verified and joined into components, members of
different components that still share a signature are compared by sketches that
bound their likeness from above, and the pairs that may link are verified too.
So no link between components is lost, and copies are not expanded into all
pairs.

Nothing gathers a whole group: members outside a group's largest component meet
all its members in cells of about ``CHUNK`` by ``CHUNK``, which tasks take one
after the other; joins by members cut hot ones into pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quernstone.llm.components import components
from quernstone.llm.kernels import U64
from quernstone.workspace import in_arrow, materialize, split_join

#: Signatures that a map task holds before it sends them, and that one task gathers.
FLUSH = 1_000_000
TASK = 1_000_000
#: Members on a side of a cell, and rows of cells that one task takes.
CHUNK = 1024
ROWS = 50_000
#: A row of pairs with what is compared counts as so many narrow ones.
WIDE = 16


def pack(sig: list[np.ndarray], member: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """A row for each bucket with the bytes of its signatures and members."""
    sig, member = np.concatenate(sig), np.concatenate(member)
    bucket = ((sig >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
    full = np.flatnonzero(np.diff(ends))
    packed = (pa.array([x[ends[b] : ends[b + 1]].tobytes() for b in full], pa.binary()) for x in (sig[order], member[order]))
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *packed], ["bucket", "sigs", "members"])


def packer(signed: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packs what ``signed`` yields: signatures and the member of each."""
    sig, member, held = [], [], 0
    for s, m in signed:
        sig.append(s)
        member.append(m)
        held += len(s)
        if held >= FLUSH:
            yield pack(sig, member, buckets)
            sig, member, held = [], [], 0
    if held:
        yield pack(sig, member, buckets)


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: pairs of members that alone share a signature.  Kind 1: (signature, member) where three or more do."""
    sig, member = [], []
    for batch in batches:
        for s, m in zip(batch.column(1), batch.column(2)):
            sig.append(np.frombuffer(s.as_buffer(), U64))
            member.append(np.frombuffer(m.as_buffer(), U64))
    if not sig:
        return
    sig, member = np.concatenate(sig), np.concatenate(member)
    order = np.argsort(sig, kind="stable")
    sig, member = sig[order], member[order]
    same = np.zeros(len(sig) + 1, bool)
    same[1:-1] = sig[1:] == sig[:-1]
    shared = same[1:] | same[:-1]
    sig, member = sig[shared], member[shared]
    if not len(sig):
        return
    order = np.lexsort((member, sig))
    sig, member = sig[order], member[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (member[1:] != member[:-1])
    sig, member = sig[new], member[new]
    head = np.ones(len(sig), bool)
    head[1:] = sig[1:] != sig[:-1]
    at = np.flatnonzero(head)
    count = np.diff(np.append(at, len(sig)))
    two = at[count == 2]
    pairs = np.unique(np.stack([member[two], member[two + 1]], 1), axis=0) if len(two) else np.zeros((0, 2), U64)
    many = np.repeat(count >= 3, count)
    for kind, x, y in ((0, pairs[:, 0], pairs[:, 1]), (1, sig[many], member[many])):
        for i in range(0, len(x), 100_000):
            part = slice(i, i + 100_000)
            columns = (pa.array(np.ascontiguousarray(v[part]).view(np.int64)) for v in (x, y))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x[part]), kind, np.int32)), *columns], ["kind", "x", "y"])


def gather(packed: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)`` of packed signatures: distinct pairs (a, b) to begin with, and (sig, node) of the larger groups."""
    found = materialize(in_arrow(packed.repartition(tasks, "bucket"), meet, "kind int, x long, y long"), "found")
    n = found.count()
    members = found.filter("kind = 1").select(F.col("x").alias("sig"), F.col("y").alias("node"))
    # Two hashes of 64 bits and the number of members say which groups are the same.
    made_of = members.groupBy("sig").agg(F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64(F.lit("two"), "node")).alias("two"), F.count("*").alias("n"))
    first = made_of.groupBy("one", "two", "n").agg(F.min("sig").alias("sig")).select("sig")
    members = materialize(members.join(first, "sig", "left_semi"), "members", n)
    weighed = held(members, "sig").select(F.explode("held").alias("sig"), "node", F.size("held").alias("w"))
    weighed = materialize(weighed, "weighed", n)
    middle = weighed.groupBy("sig").agg(F.max(F.struct("w", "node")).alias("m")).select("sig", F.col("m.node").alias("mid"))
    stars = split_join(members, middle, "sig", F.col("node")).filter("node <> mid").select(F.least("node", "mid").alias("a"), F.greatest("node", "mid").alias("b")).distinct()
    alone = found.filter("kind = 0").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return materialize(alone.union(stars).distinct(), "pairs", n), members


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of one cell after the other, from rows sorted by cell."""
    held: list[pa.RecordBatch] = []

    def whole() -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(held)
        out = {c: table.column(c).to_numpy() for c in ("left", "node", "root", "size")}
        out["sketch"] = np.frombuffer(b"".join(x.as_buffer() for x in table.column("sketch").combine_chunks()), np.uint8).reshape(len(table), -1)
        return out

    last = None
    for batch in batches:
        keys = np.stack([np.array(batch.column(i)) for i in range(3)], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
            if held and tuple(keys[i]) != last:
                yield whole()
                held = []
            held.append(batch.slice(i, j - i))
            last = tuple(keys[i])
    if held:
        yield whole()


def _across(possible: Callable[..., np.ndarray]):
    """Pairs of a cell's left and other members that are in different components and that their sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            outside, all_ = np.flatnonzero(cell["left"]), np.flatnonzero(~cell["left"])
            for i in range(0, len(outside), 64):
                some = outside[i : i + 64]
                x, y = np.nonzero(cell["root"][some][:, None] != cell["root"][all_][None, :])
                x, y = some[x], all_[y]
                for j in range(0, len(x), 8192):
                    a, b = x[j : j + 8192], y[j : j + 8192]
                    near = possible(cell["sketch"][a], cell["size"][a], cell["sketch"][b], cell["size"][b])
                    if near.any():
                        a, b = cell["node"][a[near]], cell["node"][b[near]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _near(possible: Callable[..., np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            n, m = (np.array(batch.column(i)) for i in (2, 4))
            s, t = (np.frombuffer(b"".join(x.as_buffer() for x in batch.column(i)), np.uint8).reshape(batch.num_rows, -1) for i in (3, 5))
            yield batch.select(["a", "b"]).filter(pa.array(possible(s, n, t, m)))

    return run


def _likely(pairs: DataFrame, sketches: DataFrame, possible: Callable[..., np.ndarray], name: str) -> DataFrame:
    """The pairs (a, b) that their sketches do not rule out."""
    a, b = (sketches.select(F.col("node").alias(k), F.col("size").alias(f"{k}_size"), F.col("sketch").alias(f"{k}_sketch")) for k in "ab")
    both = split_join(split_join(pairs, a, "a", F.xxhash64("b")), b, "b", F.xxhash64("a"), rows=pairs).select("a", "b", "a_size", "a_sketch", "b_size", "b_sketch")
    return materialize(in_arrow(both, _near(possible), "a long, b long"), name, WIDE * pairs.count())


def held(rows: DataFrame, *columns: str) -> DataFrame:
    """``node, held``: a row for each member with all its rows of a table; it has no more of them than its set gives signatures."""
    one = F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
    return rows.groupBy("node").agg(F.collect_list(one).alias("held"))


def connect(pairs: DataFrame, members: DataFrame, verify: Callable[[DataFrame], DataFrame], sketches: DataFrame, possible: Callable[..., np.ndarray]) -> DataFrame:
    """Verified edges (a, b) that connect every component of the links.

    ``sketches(node, size, sketch)``: counts of 8 bits, 255 for more; ``possible``
    says for rows of sketches and sizes on either side which may link.
    """
    spark = pairs.sparkSession
    likely = _likely(pairs, sketches, possible, "likely")
    edges = materialize(verify(likely), "links", WIDE * likely.count())
    names = components(edges)
    named = held(members, "sig").join(names, "node", "left").select(F.explode("held").alias("sig"), "node", F.coalesce("root", "node").alias("root"))
    n = members.count()
    named = materialize(named, "named", n)
    # Of each group with several components: its members, those outside the largest, and which that is.
    parts = named.groupBy("sig", "root").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("sig").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("parts")).filter("parts > 1")
    mixed = mixed.select("sig", F.col("most.root").alias("main"), *(F.ceil(x / CHUNK).cast("int").alias(c) for c, x in (("lefts", F.col("n") - F.col("most.n")), ("alls", F.col("n")))))
    apart = materialize(split_join(named, mixed, "sig", F.col("node")), "apart", n)
    outside = F.col("root") != F.col("main")
    n_cells = apart.agg(F.sum(F.col("lefts").cast("long") + F.when(outside, F.col("alls")).otherwise(0))).head()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_cells // ROWS))
    # A member meets its sketch once, before it is dealt to its cells.
    met = held(apart, "sig", "root", "main", "lefts", "alls").join(sketches, "node").select("node", "size", "sketch", F.inline("held"))
    deal, every = (lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")), (lambda n: F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    left = F.when(outside, F.transform(every("alls"), lambda j: place(deal("lefts"), j, True))).otherwise(F.array())
    right = F.transform(every("lefts"), lambda i: place(i, deal("alls"), False))
    cells = met.select("sig", "node", "root", "size", "sketch", F.inline(F.concat(left, right))).select("sig", "i", "j", "left", "node", "root", "size", "sketch")
    cells = cells.repartition(tasks, "sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    rest = in_arrow(cells, _across(possible), "a long, b long").distinct()
    rest = materialize(rest.join(pairs, ["a", "b"], "left_anti"), "rest", n)
    if not (found := rest.count()):
        return edges
    return edges.union(materialize(verify(rest), "more_links", WIDE * found))


def task_count(spark, signatures: int) -> int:
    """Tasks that gather so many signatures, each a bounded number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-signatures // TASK))
