"""Vectors stored by cells, and exact nearest neighbours that skip the cells that cannot hold one.

A cell is the rows whose vector is nearest to one of at most ``CELLS`` centers,
and a folder of Parquet files.  The largest distance from its center bounds how
near a cell can be to a query.  Within a cell rows are ordered by the bits of
several columns in turn, so that the statistics of row groups serve filters on
each of them, and files have Bloom filters of the ids.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quernstone.operators.retrieval import squared_distance, top
from quernstone.workspace import materialize

#: A table has at most so many cells, and until then a cell for so many rows.
CELLS, ROWS = 1024, 50_000
#: Bits of each column in the order within a cell.
BITS = 6


def interleaved(columns: Sequence[Column], bits: int = BITS) -> Column:
    """The lowest ``bits`` bits of whole numbers in turn: rows near in all columns are near in this order."""
    n = len(columns)
    picked = [F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), b * n + i) for i, c in enumerate(columns) for b in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), picked, F.lit(0).cast("long"))


def _place(vectors: DataFrame, column: str) -> Column:
    """A column's place among its quantiles, or by its hash if it is no number; nulls first."""
    if vectors.schema[column].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double"):
        ends = sorted(set(vectors.approxQuantile(column, [i / (1 << BITS) for i in range(1, 1 << BITS)], 0.005)))
        return F.coalesce(sum((F.when(F.col(column) >= e, 1).otherwise(0) for e in ends), F.lit(0)), F.lit(0))
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(1 << BITS)), F.lit(0))


def _nearest(centers: np.ndarray):
    squares = (centers * centers).sum(1)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), -1, np.int32)
        own = [i for i, v in enumerate(vectors) if v is not None and len(v) == centers.shape[1]]
        if own:
            # A null component is NaN here; such rows have no center.
            block = np.array([np.asarray(vectors.iloc[i], np.float64) for i in own])
            fit = np.isfinite(block).all(1)
            near = np.argmin(squares - 2 * (np.where(fit[:, None], block, 0) @ centers.T), 1)
            out[own] = np.where(fit, near, -1)
        return pd.Series(out)

    return nearest


def store(vectors: DataFrame, path: str, by: Sequence[str] = (), rows: int = ROWS) -> None:
    """Write ``vectors(chunk_id, embedding, ...)`` by cells, ordered by the columns ``by`` within them, under ``path``.

    Centers are a bounded sample, the vectors with the smallest hashes of their
    ids: a poor choice makes cells large, never answers wrong.  All rows are kept;
    those without a usable vector, or with one of another length than most
    centers, are in cell -1, which every search reads.  A cell that holds a large
    part of all rows is dealt over several tasks and files.  Raises ValueError
    where a column is named ``cell``.
    """
    if "cell" in (c.lower() for c in vectors.columns):
        raise ValueError("the column cell is taken")
    spark = vectors.sparkSession
    total = vectors.count()
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    n = min(max(-(-total // rows), 1), CELLS)
    found = [tuple(map(float, r[0])) for r in vectors.filter(usable).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(n).select("embedding").collect()]
    length = Counter(map(len, found)).most_common(1)[0][0] if found else 0
    centers = list(dict.fromkeys(c for c in found if len(c) == length))
    cell = _nearest(np.array(centers))(F.col("embedding")) if centers else F.lit(-1)
    order = interleaved([_place(vectors, c) for c in by])
    laid = vectors.select(*vectors.columns, cell.alias("cell"), order.alias("_order"))
    laid = laid.repartitionByRange("cell", "_order", F.xxhash64("chunk_id")).sortWithinPartitions("cell", "_order", "chunk_id").drop("_order")
    laid.write.partitionBy("cell").option("parquet.bloom.filter.enabled#chunk_id", "true").option("parquet.bloom.filter.expected.ndv#chunk_id", str(rows)).parquet(f"{path}/rows")
    middle = spark.createDataFrame(list(enumerate(map(list, centers))), "cell int, center array<double>")
    stored = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in vectors.schema)}, cell int").parquet(f"{path}/rows")
    far = F.sqrt(squared_distance("embedding", "center"))
    # At most CELLS centers, whose vectors the sample has already had on the driver.
    cells = stored.select("cell", "embedding").join(F.broadcast(middle), "cell", "left").groupBy("cell").agg(F.first("center").alias("center"), F.max(far).alias("radius"), F.count("*").alias("n"))
    cells.coalesce(1).write.parquet(f"{path}/cells")


def _bounds(cells: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, cell, n, far, least``: each query's distance from each center, and the least from a row of the cell."""
    pairs = queries.crossJoin(F.broadcast(cells))  # at most CELLS + 1 rows of cells
    far = F.coalesce(F.nanvl(F.sqrt(squared_distance("query_vector", "center")), F.lit(0.0)), F.lit(0.0))
    least = F.when(F.col("center").isNull(), 0.0).otherwise(F.greatest(far - F.col("radius"), F.lit(0.0)))
    n = F.when(F.col("center").isNull(), 0).otherwise(F.col("n"))  # rows without a center may be near to nothing
    return pairs.select("query_id", "cell", n.alias("n"), far.alias("far"), least.alias("least"))


def _visit(rows: DataFrame, visits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query in the cells that it visits; folders of other cells are not read."""
    cells = [r[0] for r in visits.select("cell").distinct().collect()]  # at most CELLS + 1
    asked = visits.select("query_id", "cell").join(queries, "query_id")
    pairs = rows.filter(F.col("cell").isin(cells)).join(asked, "cell")
    scored = pairs.select("query_id", "chunk_id", squared_distance("embedding", "query_vector").alias("distance")).filter(F.col("distance") < float("inf"))
    return top(scored, ["query_id"], [F.asc("distance"), F.asc("chunk_id")], k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 15, keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The answers of ``knn`` on a stored table, and ``query_id, cell, step``: the cells that each query has read.

    ``queries(query_id, query_vector)``, one row for each query.  Step 1 reads
    the cells that may be nearest until they have ``k`` rows; step 2 every other
    cell that may hold a row no farther than the last of these, and all where the
    filter ``keep`` leaves fewer than ``k``.  Nothing is missed: the bounds are
    widened by far more than rounding.
    """
    rows, cells = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells")
    if keep is not None:
        rows = rows.filter(keep)
    bounds = materialize(_bounds(cells, queries), "bounds")
    run = Window.partitionBy("query_id").orderBy("least", "far", "cell").rowsBetween(Window.unboundedPreceding, -1)
    first = materialize(bounds.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).filter(F.col("before") < k).select("query_id", "cell"), "first")
    near = materialize(_visit(rows, first, queries, k), "near")
    last = near.filter(F.col("rank") == k).select("query_id", F.sqrt("distance").alias("last"))
    rest = bounds.join(first, ["query_id", "cell"], "left_anti").join(last, "query_id", "left")
    rest = materialize(rest.filter(F.col("last").isNull() | (F.col("least") <= F.col("last") * (1 + 1e-9) + 1e-9)).select("query_id", "cell"), "rest")
    more = _visit(rows, rest, queries, k)
    answers = top(near.drop("rank").unionByName(more.drop("rank")), ["query_id"], [F.asc("distance"), F.asc("chunk_id")], k)
    return answers, first.withColumn("step", F.lit(1)).unionByName(rest.withColumn("step", F.lit(2)))
