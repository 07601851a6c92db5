"""The prefix trie of conversations, from polynomial fingerprints of their turns.

A turn's identity is the SHA-256 of its role and text, from which it has a number
``m``.  The fingerprint of the first ``d`` turns is ``m1 + m2 B + m3 B^2 + ...``
modulo 2^64.  Numpy scans sort conversations by ranges of (conversation, turn),
so one that holds a third of all turns is spread over many tasks; each task
leaves the sums of its last conversation, one row for each task, from which the
tasks behind it go on.  As the sums are polynomial, a conversation that takes
its first turns from another one needs no second scan: the other's sum comes
first, and the own part is shifted by a power of ``B``.

Rows with one depth and fingerprint are a group, whose representative is its
smallest conversation.  A group is right if all its rows have the
representative's last turn, compared by all 256 bits, and its fingerprint one
turn before; as that holds at every depth, all turns agree one by one.  A group
where it does not hold is a collision and is split: all parts but the
representative's take a new fingerprint of their own, they and all that comes
after them, until no group is wrong.

A node is owned by its smallest conversation, and the nodes of one owner are one
chain down from the place where it leaves its parent's chain.  So sums over
subtrees are a sum over the tree of chains, by pointer doubling in rounds that
follow the logarithm of its height, and a scan along each chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quernstone.llm.kernels import U64, mix
from quernstone.llm.meeting import task_count
from quernstone.llm.mixing import word_count
from quernstone.workspace import in_arrow, is_empty, materialize, split_join

BASE = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1
#: Turns that may come from another conversation, and how many conversations share that one.
MOST, SHARED = 3, 20
#: Conversation ids in one piece of a list that is hashed over several tasks.
PIECE = 65_536
_SAME = ("prev", "d0", "d1", "d2", "d3")


def power(exponents: np.ndarray, base: int = BASE) -> np.ndarray:
    """Powers of ``base`` modulo 2^64."""
    out, b, left = np.ones(len(exponents), U64), np.full(1, base, U64), exponents.astype(np.int64)
    while left.any():
        odd = (left & 1) == 1
        out[odd] *= b
        b, left = b * b, left >> 1
    return out


def _ahead(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch | None]]:
    """Each batch with rows, and the one after it."""
    held = None
    for batch in filter(len, batches):
        if held is not None:
            yield held, batch
        held = batch
    if held is not None:
        yield held, None


def _long(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.array(batch.column(name), np.int64)


def _starts(keys: np.ndarray) -> np.ndarray:
    """For each row the first row of its run of equal keys."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def _marks(n: int, first: bool, last: bool) -> np.ndarray:
    """1 at a task's first row, 2 at its last one, 3 if that is the same."""
    out = np.zeros(n, np.int32)
    out[0] += first
    out[-1] += 2 * last
    return out


def _carried(marks: list, state: Callable, join: Callable) -> tuple[dict[int, tuple], set[int]]:
    """What each task's first key has from the tasks before it, and the tasks whose last key goes on in the next."""
    ends: dict[int, dict[int, tuple]] = {}
    for r in marks:
        ends.setdefault(r["pid"], {}).update({side: r for side in (1, 2) if r["mark"] & side})
    before, goes_on, key, carry, last = {}, set(), None, None, None
    for pid in sorted(ends):
        begin, end = ends[pid][1], ends[pid][2]
        if last is not None and begin["key"] == key:
            before[pid] = carry
            goes_on.add(last)
        whole = state(end)
        carry = join(before[pid], whole) if pid in before and end["key"] == begin["key"] else whole
        key, last = end["key"], pid
    return before, goes_on


def turns(table: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, words`` and a tie-breaking ``row``; rows without a conversation go."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest")
    kept = table.filter("conv_id IS NOT NULL")
    return kept.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest, word_count(text).alias("words"), F.monotonically_increasing_id().alias("row"))


def _prefixes(bits: int):
    """Place and fingerprints of each turn, as far as this task knows its conversation."""
    names = ["conv_id", "pos", "fp", "prev", "d0", "d1", "d2", "d3", "words", "pid", "open", "mark"]
    mask = U64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, first, last, count, total = TaskContext.get().partitionId(), None, None, 0, np.zeros(1, U64)
        for batch, after in _ahead(batches):
            keys = _long(batch, "conv_id")
            d = np.frombuffer(b"".join(x.as_buffer() for x in batch.column("digest")), U64).reshape(-1, 4)
            start = _starts(keys)
            going = (start == 0) & (keys == last) if last is not None else np.zeros(len(keys), bool)
            pos = np.arange(len(keys)) - start + count * going
            term = (mix(d[:, 0]) & mask) * power(pos)
            fp = np.cumsum(term, dtype=U64)
            fp = fp - (fp[start] - term[start]) + total * going
            begins = first is None
            first = int(keys[0]) if begins else first
            last, count, total = int(keys[-1]), int(pos[-1]) + 1, fp[-1:]
            longs = (keys, pos, fp.view(np.int64), (fp - term).view(np.int64), *(np.ascontiguousarray(d[:, i]).view(np.int64) for i in range(4)))
            made = (pa.array(np.full(len(keys), pid, np.int32)), pa.array(keys == first), pa.array(_marks(len(keys), begins, after is None)))
            yield pa.RecordBatch.from_arrays([*map(pa.array, longs), batch.column("words"), *made], names)

    return run


_SCANNED = "conv_id long, pos long, fp long, prev long, d0 long, d1 long, d2 long, d3 long, words long, pid int, open boolean, mark int"
_ROW = "conv_id long, depth long, fp long, prev long, d0 long, d1 long, d2 long, d3 long, words long"


def _known(batch: pa.RecordBatch, before: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place and fingerprints of a batch's turns, with what came in earlier tasks."""
    pos, fp, prev = _long(batch, "pos"), _long(batch, "fp").view(U64), _long(batch, "prev").view(U64)
    pid, open_ = _long(batch, "pid"), np.array(batch.column("open"), bool)
    pos, fp, prev = pos.copy(), fp.copy(), prev.copy()
    for p in np.unique(pid[open_]).tolist():
        if p in before:
            n, s = before[p]
            rows = open_ & (pid == p)
            shift = U64(pow(BASE, n, 1 << 64))
            pos[rows] += n
            fp[rows] = fp[rows] * shift + U64(s)
            prev[rows] = prev[rows] * shift + U64(s)
    return pos, fp, prev


def _rows(batch: pa.RecordBatch, keep: np.ndarray, depth: np.ndarray, fp: np.ndarray, prev: np.ndarray) -> pa.RecordBatch:
    made = [pa.array(x) for x in (depth, fp.view(np.int64), prev.view(np.int64))]
    columns = [batch.column("conv_id"), *made, *(batch.column(c) for c in ("d0", "d1", "d2", "d3", "words"))]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "depth", "fp", "prev", "d0", "d1", "d2", "d3", "words"]).filter(pa.array(keep))


def _heads(before: dict[int, tuple]):
    """The first turns of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            pos, fp, prev = _known(batch, before)
            yield _rows(batch, pos < MOST, pos + 1, fp, prev)

    return run


def _spliced(before: dict[int, tuple]):
    """The own turns of rebuilt conversations, after the ``taken`` ones of another in place of the first ``skip``."""
    back = [pow(BASE, -k, 1 << 64) for k in range(MOST + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            pos, fp, prev = _known(batch, before)
            skip, taken = _long(batch, "skip"), _long(batch, "taken")
            lead, cut = _long(batch, "lead").view(U64), _long(batch, "cut").view(U64)
            shift = np.array(back, U64)[skip - taken]
            yield _rows(batch, pos >= skip, pos - skip + taken + 1, (fp - cut) * shift + lead, (prev - cut) * shift + lead)

    return run


def rebuilt(table: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(conversations, rows)``: every conv_id, and a row for each turn of a rebuilt one with its depth and fingerprints.

    ``bits`` of a turn's number count; fewer make collisions, which the tests want.
    """
    narrow = materialize(turns(table), "turns")
    order = (F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row"))
    spread = narrow.repartitionByRange(task_count(narrow.sparkSession, narrow.count()), *order).sortWithinPartitions(*order)
    scanned = materialize(in_arrow(spread.select("conv_id", "digest", "words"), _prefixes(bits), _SCANNED), "scanned")
    marks = scanned.filter("mark > 0").select(F.col("conv_id").alias("key"), "pid", "mark", "pos", "fp").collect()  # two for each task
    before, _ = _carried(marks, lambda r: (r["pos"] + 1, r["fp"] & _ALL), lambda a, b: (a[0] + b[0], (a[1] + b[1] * pow(BASE, a[0], 1 << 64)) & _ALL))
    heads = materialize(in_arrow(scanned.filter(F.col("pos") < MOST), _heads(before), _ROW), "heads")
    at = [F.coalesce(F.max(F.when(F.col("depth") == k, F.col("fp"))), F.lit(0)).alias(f"s{k}") for k in range(1, MOST + 1)]
    convs = heads.groupBy("conv_id").agg(F.max("depth").alias("n"), *at)
    sums = lambda k, side: F.element_at(F.array(F.lit(0).cast("long"), *(F.col(f"{side}.s{i}") for i in range(1, MOST + 1))), (k + 1).cast("int"))
    skip = F.pmod(F.crc32(F.col("c.conv_id").cast("string").cast("binary")), F.lit(MOST + 1))
    plan = convs.alias("c").join(convs.alias("b"), F.col("c.conv_id") - F.col("c.conv_id") % SHARED == F.col("b.conv_id"), "left")
    plan = plan.withColumn("skip", skip).withColumn("taken", F.least("skip", F.coalesce("b.n", F.lit(0))))
    lead, cut = F.when(F.col("taken") > 0, sums(F.col("taken"), "b")).otherwise(F.lit(0)), sums(F.least("skip", "c.n"), "c")
    plan = materialize(plan.select("c.conv_id", F.col("b.conv_id").alias("base"), "skip", "taken", lead.alias("lead"), cut.alias("cut")), "plan")
    own = split_join(scanned, plan.drop("base"), "conv_id", F.col("pos"))
    own = in_arrow(own, _spliced(before), _ROW)
    given = plan.select(F.col("conv_id").alias("c"), F.col("base").alias("conv_id"), "taken").join(heads, "conv_id").filter("depth <= taken")
    given = given.select(F.col("c").alias("conv_id"), *own.columns[1:])
    return plan.select("conv_id"), materialize(own.union(given), "rows")


def groups(rows: DataFrame) -> DataFrame:
    """A row for each depth and fingerprint: its smallest conversation, its number, and whether it is a collision."""
    out = rows.groupBy("depth", "fp").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n"), F.max("words").alias("words"), *(f(c).alias(f"{c}_{f.__name__}") for c in _SAME for f in (F.min, F.max)))
    wrong: Column = F.lit(False)
    for c in _SAME:
        wrong = wrong | (F.col(f"{c}_min") != F.col(f"{c}_max"))
    return out.select("depth", "fp", "owner", "n", "words", F.col("prev_min").alias("prev"), wrong.alias("wrong"))


def split(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` where each part of a wrong group, but that of its representative, has its own fingerprint from there on."""
    wrong = nodes.filter("wrong").select("depth", "fp", "owner")
    key = ("depth", "fp", *_SAME)
    parts = rows.join(wrong, ["depth", "fp"]).groupBy(*key).agg(F.min("conv_id").alias("least"), F.min("owner").alias("owner"))
    parts = materialize(parts.filter("least <> owner").select(*key, F.xxhash64(*key).alias("salt")), "parts")
    points = materialize(rows.join(parts, list(key)).select("conv_id", F.col("depth").alias("from"), "salt"), "points")
    moved = rows.select("conv_id", "depth").join(points, "conv_id").filter(F.col("from") <= F.col("depth"))
    moved = moved.groupBy("conv_id", "depth").agg(F.bit_xor("salt").alias("x"), F.bit_xor(F.when(F.col("from") < F.col("depth"), F.col("salt"))).alias("y"))
    out = rows.join(moved, ["conv_id", "depth"], "left")
    zero = F.lit(0).cast("long")
    out = out.withColumn("fp", F.col("fp").bitwiseXOR(F.coalesce("x", zero))).withColumn("prev", F.col("prev").bitwiseXOR(F.coalesce("y", zero)))
    return materialize(out.select(rows.columns), "rows")


def verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, nodes)`` without a collision."""
    while True:
        nodes = materialize(groups(rows), "groups")
        if is_empty(nodes.filter("wrong")):
            return rows, nodes.drop("wrong")
        rows = split(rows, nodes)


def chains(nodes: DataFrame, top: int) -> DataFrame:
    """The chain of each owner: where it starts and ends, its parent's owner, what its nodes save, and ``leaves``, 1 if its end has no child.

    ``top`` owns the root and has no parent.
    """
    own = nodes.groupBy("owner").agg(F.min("depth").alias("start"), F.max("depth").alias("last"), F.min_by("prev", "depth").alias("prev"), F.sum((F.col("n") - 1) * F.col("words")).alias("saved"))
    own = materialize(own, "own")
    at = lambda depth, fp: F.concat_ws(":", depth, fp).alias("at")
    first = own.filter(F.col("start") <= 1).withColumn("parent", F.when(F.col("owner") != top, F.lit(top)))
    deep = own.filter(F.col("start") > 1).withColumn("at", at(F.col("start") - 1, "prev"))
    # A parent with another owner has two members at least.
    parents = nodes.filter("n > 1").select(at(F.col("depth"), "fp"), F.col("owner").alias("parent"))
    deep = split_join(materialize(deep, "deep"), parents, "at", F.xxhash64("owner"))
    out = materialize(first.unionByName(deep.drop("at")).drop("prev"), "chains")
    ends = out.filter("parent IS NOT NULL").select(F.col("parent").alias("owner"), (F.col("start") - 1).alias("last"), F.lit(0).cast("long").alias("leaves")).distinct()
    return out.join(ends, ["owner", "last"], "left").withColumn("leaves", F.coalesce("leaves", F.lit(1).cast("long")))


def totals(links: DataFrame, top: int) -> DataFrame:
    """``links(owner, parent, leaves, saved)`` with both sums taken over all chains below, by pointer doubling."""
    now = materialize(links.select("owner", F.col("parent").alias("up"), "leaves", "saved"), "totals")
    while not is_empty(moving := now.filter("up IS NOT NULL")):
        more = moving.groupBy(F.col("up").alias("owner")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        grown = now.join(more, "owner", "left").select("owner", "up", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        grown = materialize(grown, "grown")
        above = now.select(F.col("owner").alias("up"), F.col("up").alias("next"))
        # What hangs on the top chain goes nowhere from there.
        done = grown.filter(F.col("up").isNull() | (F.col("up") == top)).select("owner", F.lit(None).cast("long").alias("up"), "leaves", "saved")
        rest = materialize(grown.filter(F.col("up") != top), "rest")
        jumped = rest.select("owner", F.col("up"), "leaves", "saved")
        if not is_empty(rest):
            jumped = split_join(rest, above, "up", F.xxhash64("owner")).select("owner", F.col("next").alias("up"), "leaves", "saved")
        now = materialize(done.union(jumped), "totals")
    return now.select("owner", "leaves", "saved")


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of a chain's totals at each of its nodes, as far as this task knows it, and whether the chain goes on."""
    names = ["owner", "depth", "fp", "n", "parent", "branches", "leaves", "saved", "next_leaves", "next_saved", "on", "pid", "open", "mark"]
    pid, first, last = TaskContext.get().partitionId(), None, None
    carry = {"leaves": 0, "saved": 0}
    for batch, after in _ahead(batches):
        keys = _long(batch, "owner")
        start = _starts(keys)
        going = (start == 0) & (keys == last) if last is not None else np.zeros(len(keys), bool)
        out, nexts = [], []
        for c in ("leaves", "saved"):
            total, off = _long(batch, c), _long(batch, f"off_{c}")
            run = np.cumsum(total - off)
            following = run - (run[start] - (total - off)[start]) + carry[c] * going
            out.append(following + off)
            nexts.append(following)
            carry[c] = int(following[-1])
        on = np.append(keys[1:] == keys[:-1], after is not None and int(_long(after.slice(0, 1), "owner")[0]) == int(keys[-1]))
        begins = first is None
        first = int(keys[0]) if begins else first
        last = int(keys[-1])
        same = [batch.column(c) for c in ("owner", "depth", "fp", "n", "parent", "branches")]
        yield pa.RecordBatch.from_arrays([*same, *map(pa.array, (*out, *nexts, on)), pa.array(np.full(len(keys), pid, np.int32)), pa.array(keys == first), pa.array(_marks(len(keys), begins, after is None))], names)


def sized(nodes: DataFrame, links: DataFrame, sums: DataFrame) -> DataFrame:
    """Every node with its parent's owner, children, leaves and saved words, from its chain's totals less what leaves the chain above it."""
    whole = links.drop("leaves", "saved").join(sums, "owner")
    zero = [F.lit(0).cast("long").alias(c) for c in ("branches", "off_leaves", "off_saved")]
    heads = whole.select("owner", F.col("start").alias("depth"), "parent", "leaves", "saved", *zero)
    off = whole.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("owner"), (F.col("start") - 1).alias("depth"))
    off = off.agg(F.count("*").alias("branches"), F.sum("leaves").alias("off_leaves"), F.sum("saved").alias("off_saved"))
    none = F.lit(None).cast("long").alias("parent")
    extra = heads.union(off.select("owner", "depth", none, *(F.lit(0).cast("long") for _ in range(2)), "branches", "off_leaves", "off_saved"))
    extra = extra.groupBy("owner", "depth").agg(F.max("parent").alias("parent"), *(F.sum(c).alias(c) for c in ("leaves", "saved", "branches", "off_leaves", "off_saved")))
    out = nodes.join(extra, ["owner", "depth"], "left").fillna(0, ["leaves", "saved", "branches", "off_leaves", "off_saved"])
    out = out.withColumn("off_saved", F.col("off_saved") + (F.col("n") - 1) * F.col("words"))
    out = materialize(out.select("owner", "depth", "fp", "n", "parent", "branches", "leaves", "saved", "off_leaves", "off_saved"), "weighed")
    order = ("owner", "depth")
    spread = out.repartitionByRange(task_count(out.sparkSession, out.count()), *order).sortWithinPartitions(*order)
    schema = "owner long, depth long, fp long, n long, parent long, branches long, leaves long, saved long, next_leaves long, next_saved long, on boolean, pid int, open boolean, mark int"
    out = materialize(in_arrow(spread, _along, schema), "along")
    marks = out.filter("mark > 0").select(F.col("owner").alias("key"), "pid", "mark", "next_leaves", "next_saved").collect()  # two for each task
    before, goes_on = _carried(marks, lambda r: (r["next_leaves"], r["next_saved"]), lambda a, b: (a[0] + b[0], a[1] + b[1]))

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            pid, open_, mark = _long(batch, "pid"), np.array(batch.column("open"), bool), _long(batch, "mark")
            sums = [_long(batch, c).copy() for c in ("leaves", "saved")]
            for p in np.unique(pid[open_]).tolist():
                for c, have in zip(sums, before.get(p, (0, 0))):
                    c[open_ & (pid == p)] += have
            on = np.array(batch.column("on"), bool) | ((mark >= 2) & np.isin(pid, list(goes_on)))
            depth, owner = _long(batch, "depth"), batch.column("owner")
            above = pc.if_else(pa.array(depth == 0), None, pc.coalesce(batch.column("parent"), owner))
            children = _long(batch, "branches") + on
            yield pa.RecordBatch.from_arrays([owner, batch.column("depth"), batch.column("fp"), above, batch.column("n"), pa.array(children), *map(pa.array, sums)], ["conv_id", "depth", "fp", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"])

    return in_arrow(out, complete, "conv_id long, depth long, fp long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's list that lies within this task; of the task's first and last list, which others may share, the ids in pieces."""
    names, pid = ["depth", "fp", "pid", "seq", "ids", "sha"], TaskContext.get().partitionId()
    first = last = None
    sha, seq, out = None, 0, []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    held: list[bytes] = []  # pieces of the present list, while it may be the task's last one
    for batch, after in _ahead(batches):
        depth, fp, ids = (_long(batch, c) for c in ("depth", "fp", "conv_id"))
        cuts = np.flatnonzero((depth[1:] != depth[:-1]) | (fp[1:] != fp[:-1])) + 1
        for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(ids)]):
            key = (int(depth[i]), int(fp[i]))
            if key != last:
                if last is not None and last != first:
                    out.append((*last, pid, 0, None, sha.hexdigest()))
                first = key if first is None else first
                last, sha, seq = key, hashlib.sha256(), 0
                held = []
            for k in range(i, j, PIECE):
                piece = ",".join(map(str, ids[k : min(k + PIECE, j)].tolist())).encode()
                if key == first:
                    out.append((*key, pid, seq, piece, None))
                else:
                    sha.update(b"," * (seq > 0) + piece)
                    held.append(piece)
                seq += 1
                if len(out) >= 64:
                    yield flush()
        if after is None and last != first:
            out.extend((*last, pid, k, piece, None) for k, piece in enumerate(held))
        if out:
            yield flush()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each list, from its pieces in order."""
    last, sha = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]]), pa.array([sha.hexdigest()])], ["depth", "fp", "sha"])

    for batch in batches:
        for depth, fp, piece in zip(batch.column("depth").to_pylist(), batch.column("fp").to_pylist(), batch.column("ids")):
            if (depth, fp) != last:
                if last is not None:
                    yield done()
                last, sha = (depth, fp), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(piece.as_buffer())
    if last is not None:
        yield done()


def ends(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """``depth, fp, sha`` of each node where a conversation ends: the hash of their ids, ascending."""
    last = rows.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by("fp", "depth").alias("fp"))
    last = convs.join(last, "conv_id", "left").fillna(0, ["depth", "fp"])
    last = materialize(last.select("depth", "fp", "conv_id"), "ends")
    order = ("depth", "fp", "conv_id")
    spread = last.repartitionByRange(task_count(last.sparkSession, last.count()), *order).sortWithinPartitions(*order)
    found = materialize(in_arrow(spread, _pieces, "depth long, fp long, pid int, seq long, ids binary, sha string"), "pieces")
    shared = found.filter("ids IS NOT NULL").repartition("depth", "fp").sortWithinPartitions("depth", "fp", "pid", "seq").select("depth", "fp", "ids")
    return found.filter("sha IS NOT NULL").select("depth", "fp", "sha").union(in_arrow(shared, _joined, "depth long, fp long, sha string"))


def trie(table: DataFrame, bits: int = 64) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, from ``table(conv_id, turn, role, text)``.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``; (conv_id, depth) is unique.  Turns are ordered by
    ``turn``, null first, equal ones by the SHA-256 of role and text; repeated
    rows are turns of their own.  Null role and text are empty, and an empty turn
    is a turn.  Rows whose conv_id is null belong to no conversation and go.  An
    empty table has no conversation and so no node.  Other columns are not read.
    """
    convs, rows = rebuilt(table, bits)
    top = convs.agg(F.min("conv_id").alias("top"), F.count("*").alias("n")).head()
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    if not top["n"]:
        kinds = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in columns)
        return table.sparkSession.createDataFrame([], kinds)
    rows, nodes = verified(rows)
    zero = F.lit(0).cast("long")
    root = convs.limit(1).select(zero.alias("depth"), zero.alias("fp"), F.lit(top["top"]).alias("owner"), F.lit(top["n"]).alias("n"), zero.alias("words"), zero.alias("prev"))
    nodes = nodes.unionByName(root)
    links = materialize(chains(nodes, top["top"]), "links")
    out = sized(nodes, links, totals(links, top["top"])).join(ends(convs, rows), ["depth", "fp"], "left")
    return out.withColumn("ends_sha256", F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest()))).select(*columns)


def op12(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
