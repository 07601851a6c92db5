"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits space by hyperplanes between two random members of the node,
until a leaf would hold about ``LEAF`` rows of the table.  The trees are built on
the driver from a bounded sample: ``SAMPLE`` vectors, or one in 32 up to
``MOST``; every row is indexed.  For largest inner products, vectors are first
made equally long by one more dimension (``sqrt(longest^2 - length^2)``, 0 for
queries), which keeps the order.

A query walks all trees with one priority queue, ordered by the smallest
margin on the way, and visits leaves until they hold a number of the sampled
vectors.  ``calibrate`` finds that number: for ``ASKED`` of the queries the true
neighbours among all rows are computed, and the number is what reaches the
wanted part of them.  So the rows that a query meets are no more than its
recall needs, and their part falls as the table grows and neighbours come
nearer.  The visits meet the rows leaf by leaf; leaves with many rows are cut
into pieces by the hash of the vector, and the query visits every piece.  The
visits of the calibrated queries say how many a leaf will have: one with many is
copied, and a query visits one of the copies.
Candidates are scored exactly on the original vectors, in double precision,
summed from the first dimension to the last.

Rows with equal vectors are one member with their smallest ids, since with ties
going to the smaller id no others can be among the nearest.  Members meet again
by a hash of 63 bits of their vectors.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quernstone.workspace import in_arrow, materialize

SAMPLE, MOST = 20_000, 100_000
TREES = 12
LEAF = 256
#: Queries whose true neighbours are computed to calibrate the search.
ASKED = 100
#: A piece of a leaf has about so many members, and a copy of it so many visits.
PIECE, VISITS = 4_000, 50_000
#: Rows and visits that a search task takes, and queries whose best it holds.
TASK, HELD = 100_000, 20_000
SALTS = 32


def build(x: np.ndarray, trees: int, leaf: int, seed: int = 3) -> list[dict]:
    """Trees as arrays: normal and offset of each node, its children (a leaf k is -k - 1), and the sampled vectors of each leaf."""
    r, out = np.random.default_rng(seed), []
    for _ in range(trees):
        normal, offset, child, sizes = [], [], [], []

        def grow(rows: np.ndarray) -> int:
            if len(rows) > leaf:
                for _ in range(4):
                    a, b = x[r.choice(rows, 2, replace=False)]
                    n = a - b
                    if not n.any():
                        continue
                    at = x[rows] @ n
                    cut = np.median(at)
                    side = at > cut
                    if 0.1 < side.mean() < 0.9:
                        k = len(normal)
                        length = np.linalg.norm(n)
                        normal.append(n / length)
                        offset.append(cut / length)
                        child.append([0, 0])
                        child[k] = [grow(rows[~side]), grow(rows[side])]
                        return k
            sizes.append(len(rows))
            return -len(sizes)

        grow(np.arange(len(x)))
        out.append({"normal": np.array(normal).reshape(-1, x.shape[1]), "offset": np.array(offset), "child": child, "sizes": sizes})
    return out


def leaves(tree: dict, x: np.ndarray) -> np.ndarray:
    """The leaf of each row of ``x``."""
    at = np.full(len(x), 0 if len(tree["offset"]) else -1)
    child = np.array(tree["child"]).reshape(-1, 2)
    while (live := np.flatnonzero(at >= 0)).size:
        node = at[live]
        right = np.einsum("ij,ij->i", x[live], tree["normal"][node]) > tree["offset"][node]
        at[live] = child[node, right.astype(int)]
    return -at - 1


def visits(forest: list[dict], x: np.ndarray, visit: int) -> Iterator[tuple[int, int, int]]:
    """(query, tree, leaf) in the order of one priority queue over all trees."""
    margins = [x @ t["normal"].T - t["offset"] for t in forest]
    for q in range(len(x)):
        heap = [(-np.inf, k, 0 if len(t["offset"]) else -1) for k, t in enumerate(forest)]
        heapq.heapify(heap)
        seen = 0
        while heap and seen < visit:
            worst, k, node = heapq.heappop(heap)
            if node < 0:
                seen += forest[k]["sizes"][-node - 1]
                yield q, k, -node - 1
                continue
            m = margins[k][q, node]
            left, right = forest[k]["child"][node]
            heapq.heappush(heap, (max(worst, m), k, left))
            heapq.heappush(heap, (max(worst, -m), k, right))


def calibrate(forest: list[dict], queries: np.ndarray, near: list[np.ndarray], recall: float) -> int:
    """How many sampled vectors to visit so that ``queries`` find ``recall`` of their true neighbours ``near``.

    All vectors are lifted, those of the queries with a last dimension of 0.
    """
    whole = sum(sum(t["sizes"]) for t in forest)
    need = [np.full(len(n), whole) for n in near]
    at = [[leaves(t, n) for t in forest] for n in near]
    open_, last, seen = [np.ones(len(n), bool) for n in near], -1, 0
    for q, t, leaf in visits(forest, queries, whole):
        seen, last = (0 if q != last else seen) + forest[t]["sizes"][leaf], q
        if open_[q].any():
            hit = open_[q] & (at[q][t] == leaf)
            need[q][hit] = seen
            open_[q] &= ~hit
    need = np.concatenate([*need, np.zeros(0, int)])
    return int(np.quantile(need, recall, method="higher")) + 1 if len(need) else 1


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))[:, None]], 1)


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda c: c != 0)


def _unpack(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _packed(kind: str, name: str):
    """Ids and the bytes of their vectors; -0 counts as 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in filter(len, batches):
            v = [(x + x.dtype.type(0)).tobytes() for x in _matrix(part.column(1)).astype(kind)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(v, pa.binary())], [name, "v"])

    return run


def _truth(asked: np.ndarray, keep: int, kind: str):
    """The ``keep`` members nearest to each asked vector among those of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, score = np.zeros((len(asked), 0), object), np.zeros((len(asked), 0))
        for batch in filter(len, batches):
            v = np.array(batch.column(0).to_pylist(), object)
            near = asked @ _unpack(batch.column(0), kind).astype(np.float64).T
            top = np.argsort(-near, 1, kind="stable")[:, :keep]
            held = np.concatenate([held, v[top]], 1)
            score = np.concatenate([score, np.take_along_axis(near, top, 1)], 1)
            top = np.argsort(-score, 1, kind="stable")[:, :keep]
            held, score = np.take_along_axis(held, top, 1), np.take_along_axis(score, top, 1)
        q = np.repeat(np.arange(len(asked)), score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(score.ravel()), pa.array(held.ravel().tolist(), pa.binary())], ["q", "score", "v"])

    return run


def _pair(forest, longest: float, visit: int, pieces: dict, copies: dict, kind: str):
    """Rows of the index (kind 0) and visits of the queries (kind 1), by tree, leaf and piece.

    A row goes to one of its leaf's ``pieces``, in each of its ``copies``; a
    visit to each of the pieces, in one of the copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                raw = _unpack(batch.column(0), kind).astype(np.float64)
                is_query, key = np.array(batch.column(2)), np.array(batch.column(3))
                lifted = _lift(raw, longest)
                rows, places = [], []
                for k, tree in enumerate(trees):
                    for i, leaf in enumerate(leaves(tree, lifted)):
                        at = k, int(leaf)
                        piece, every = int(key[i] % pieces.get(at, 1)), copies.get(at, 1)
                        rows += [(i, 0)] * every
                        places += [(*at, piece * every + copy) for copy in range(every)]
                asked = np.flatnonzero(is_query)
                lifted[:, -1] = 0
                for some in np.split(asked, range(100, len(asked), 100)):
                    for q, k, leaf in visits(trees, lifted[some], visit):
                        every, i = copies.get((k, leaf), 1), int(some[q])
                        for piece in range(pieces.get((k, leaf), 1)):
                            rows.append((i, 1))
                            places.append((k, leaf, piece * every + int(key[i] % every)))
                row, side = (np.array(x) for x in zip(*rows))
                order = np.arange(len(row))
                for part in np.split(order, range(20_000, len(order), 20_000)):
                    where = np.array([places[i] for i in part], np.int32).reshape(-1, 3)
                    own = pa.array(row[part])
                    columns = [*(pa.array(where[:, i]) for i in range(3)), pa.array(side[part].astype(np.int32)), pa.array(key[row[part]])]
                    columns += [batch.column(0).take(own), batch.column(1).take(own)]
                    yield pa.RecordBatch.from_arrays(columns, ["tree", "leaf", "piece", "kind", "key", "v", "ids"])

    return run


class _Best:
    """The best members for each query, exactly scored; ``floor`` is what a member must reach to be among them."""

    def __init__(self, keep: int):
        self.keep = keep
        self.clear()

    def clear(self) -> None:
        self.number, self.floor, self.ids = {}, np.zeros(0), {}
        self.held, self.new, self.waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0

    def numbers(self, queries: np.ndarray) -> np.ndarray:
        """Consecutive numbers of the queries, by their keys."""
        got = np.array([self.number.setdefault(q, len(self.number)) for q in queries.tolist()], np.int64)
        self.floor = np.append(self.floor, np.full(len(self.number) - len(self.floor), -np.inf))
        return got

    def compare(self, queries: np.ndarray, q: np.ndarray, members: np.ndarray, x: np.ndarray, ids: pa.Array) -> None:
        """Meets queries, by number, with a piece's members, by key."""
        near = q @ x.T
        floor = self.floor[queries]
        if len(x) > self.keep:
            floor = np.maximum(floor, np.partition(near, len(x) - self.keep, 1)[:, len(x) - self.keep])
        # Products summed in another order differ by less than this from the exact scores.
        slack = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        i, j = np.nonzero(near >= (floor - slack)[:, None])
        for at in np.unique(j):
            if members[at] not in self.ids:
                self.ids[members[at]] = ids[int(at)].as_py()
        for part in range(0, len(i), 8192):
            a, b = i[part : part + 8192], j[part : part + 8192]
            exact = np.cumsum(q[a] * x[b], 1)[:, -1]  # in order, so that every task gets the same sum
            self.new.append((queries[a], members[b], exact))
            self.waiting += len(a)
        if self.waiting > 200_000:
            self.prune()

    def prune(self) -> None:
        """Keeps the best ``keep`` members of each query and those that tie with the last."""
        query, member, score = (np.concatenate(x) for x in zip(self.held, *self.new))
        order = np.lexsort((member, -score, query))
        query, member, score = query[order], member[order], score[order]
        fresh = np.ones(len(query), bool)
        fresh[1:] = (query[1:] != query[:-1]) | (member[1:] != member[:-1])
        query, member, score = query[fresh], member[fresh], score[fresh]
        first = np.searchsorted(query, query, "left")
        last = np.minimum(first + self.keep - 1, np.searchsorted(query, query, "right") - 1)
        full = last - first == self.keep - 1
        self.floor[query[full]] = score[last[full]]
        kept = score >= score[last]
        self.held, self.new, self.waiting = (query[kept], member[kept], score[kept]), [], 0
        self.ids = {m: self.ids[m] for m in np.unique(self.held[1])}

    def flush(self) -> Iterator[pa.RecordBatch]:
        """What is held, with the smallest ids of each query's best; then nothing is held."""
        self.prune()
        keys, (query, member, score) = list(self.number), self.held
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else []
        out: list[tuple[int, int, float]] = []
        for at, end in zip(starts, np.append(starts[1:], len(query))):
            flat = sorted((-s, i) for m, s in zip(member[at:end], score[at:end].tolist()) for i in self.ids[m])[: self.keep]
            out += [(keys[query[at]], i, -s) for s, i in flat]
        for part in range(0, len(out), 50_000):
            columns = zip(*out[part : part + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["key", "vec_id", "score"])
        self.clear()


def _search(keep: int, kind: str):
    """The best members for each query among those that share a leaf's piece, exactly scored.

    Rows come sorted, a piece's members before its visits, so that a task holds
    one piece's members, a batch of visits and the best of ``HELD`` queries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, place, held = _Best(keep), None, []
        for batch in filter(len, batches):
            where = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
            key, vec, ids = batch.column(4).to_numpy(), _unpack(batch.column(5), kind), batch.column(6)
            starts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(1)])
            for at, end in zip(starts, np.append(starts[1:], len(where))):
                if place != (at_ := tuple(where[at, :3])):
                    place, held = at_, []
                    if len(best.number) > HELD:
                        yield from best.flush()
                if not where[at, 3]:
                    held.append((key[at:end], vec[at:end].astype(np.float64), ids.slice(at, end - at)))
                elif held:
                    if len(held) > 1:
                        keys, xs, lists = zip(*held)
                        held = [(np.concatenate(keys), np.concatenate(xs), pa.concat_arrays(lists))]
                    for some in range(at, end, 500):
                        part = slice(some, min(some + 500, end))
                        best.compare(best.numbers(key[part]), vec[part].astype(np.float64), *held[0])
        yield from best.flush()

    return run


def _fewest_ids(packed: DataFrame, keep: int) -> DataFrame:
    """``v, ids``: the ``keep`` smallest ids of each vector, dealt over tasks first where many rows share one."""
    smallest = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, keep)
    dealt = packed.groupBy("v", F.pmod("vec_id", F.lit(SALTS)).alias("salt"), (F.floor(F.col("vec_id") / SALTS) % SALTS).alias("salt2"))
    once = dealt.agg(smallest(F.collect_set("vec_id")).alias("ids"))
    half = once.groupBy("v", "salt").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"))
    return half.groupBy("v").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"))


def nearest(rows: DataFrame, is_query: Column, k: int = 20, recall: float = 0.94, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows of each query but itself.

    ``rows(vec_id, embedding)``, an array of floats or doubles, is scored as it
    is.  Vectors that are null, empty, zero or hold a null or non-finite
    component take no part, nor do vectors of another length than the most
    common one.  Ties go to the smaller vec_id; repeated ids are one row.  With
    fewer candidates than ``k`` all found are returned; an empty table gives no
    rows.
    """
    spark, keep = rows.sparkSession, k + 4
    kind = "<f4" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    good = rows.withColumn("_q", F.coalesce(is_query, F.lit(False))).filter(_usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    good = good.select("vec_id", "embedding", "_q")
    length = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").head()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = good.filter(F.size("embedding") == length["n"])
    packed = in_arrow(good.select("vec_id", "embedding"), _packed(kind, "vec_id"), "vec_id long, v binary")
    key = F.xxhash64("v").alias("key")
    asked = in_arrow(good.filter("_q").select("vec_id", "embedding"), _packed(kind, "query_id"), "query_id long, v binary")
    asked = materialize(asked.select("query_id", key).distinct(), "asked", good.count())
    members = _fewest_ids(packed, keep).select("v", "ids", key).join(asked.select("key").distinct().withColumn("q", F.lit(True)), "key", "left")
    members = members.select("v", "ids", F.coalesce("q", F.lit(False)).alias("q"), F.shiftrightunsigned("key", 1).alias("spread"), "key")
    members = materialize(members, "members")
    count, queries = members.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).head()

    def drawn(among: DataFrame, mark: str, wanted: int, n: int) -> np.ndarray:
        odds = F.lit(int(min(1.0, wanted / max(n, 1)) * (1 << 30)))
        taken = among.filter(F.pmod(F.xxhash64(F.lit(mark), "key"), F.lit(1 << 30)) < odds).select("v").collect()
        found = sorted((np.frombuffer(r["v"], kind) for r in taken), key=bytes)
        return np.stack(found).astype(np.float64) if found else np.zeros((0, length["n"]))

    x = drawn(members, "sample", max(sample, min(count // 32, MOST)), count)
    squares = good.select(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))).head()[0]
    longest = float(np.sqrt(squares))
    scale = count / max(len(x), 1)
    forest = build(_lift(x, longest), trees, max(8, int(leaf / max(scale, 1))))
    tried = drawn(members.filter("q"), "asked", ASKED, queries)
    true = in_arrow(members.select("v"), _truth(tried, k + 1, kind), "q long, score double, v binary") if len(tried) else None
    near = [np.zeros((0, length["n"]))] * len(tried)
    if true is not None:
        best = true.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "v"))).filter(F.col("r") <= k + 1).collect()
        for i in range(len(tried)):  # but for the query itself
            own = [np.frombuffer(r["v"], kind).astype(np.float64) for r in best if r["q"] == i]
            near[i] = np.array([v for v in own if not np.array_equal(v, tried[i])][:k]).reshape(-1, length["n"])
    flat = np.concatenate([tried, np.zeros((len(tried), 1))], 1)
    visit = calibrate(forest, flat, [_lift(n, longest) for n in near], recall) if len(x) else 1
    # The sample says how many rows a leaf has, the tried queries how many visits.
    pieces = {(t, i): int(n) for t, tree in enumerate(forest) for i, s in enumerate(tree["sizes"]) if (n := -(-s * scale // PIECE)) > 1}
    asks, times = Counter((t, i) for _, t, i in visits(forest, flat, visit)), queries / max(len(tried), 1)
    copies = {at: int(c) for at, n in asks.items() if (c := -(-n * times // VISITS)) > 1}
    shared = spark.sparkContext.broadcast(forest)  # of at most MOST vectors
    pair = _pair(shared, longest, visit, pieces, copies, kind)
    placed = in_arrow(members.select("v", "ids", "q", "spread"), pair, "tree int, leaf int, piece int, kind int, key long, v binary, ids array<long>")
    # A query's key is its member's spread, so that searches and queries meet again by it.
    load = count * trees + sum(n * times * pieces.get(at, 1) for at, n in asks.items())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(load // TASK) + 1)
    met = placed.repartition(tasks, "tree", "leaf", "piece").sortWithinPartitions("tree", "leaf", "piece", "kind")
    found = in_arrow(met, _search(keep, kind), "key long, vec_id long, score double").distinct()
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1).drop("r")
    best = best.join(asked.select("query_id", F.shiftrightunsigned("key", 1).alias("key")), "key").filter("query_id <> vec_id")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, F.col("vec_id") % 20 == 0)
