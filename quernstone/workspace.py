"""Intermediate tables in the folder that all executors share, and what keeps tasks bounded.

The folder is the session's ``spark.checkpoint.dir``.  Only a session on one
machine may do without: it then gets a temporary folder of that machine.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_LOCAL: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []
#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20
#: Narrow rows in a file of a table whose size is known.
FILE_ROWS = 50_000
#: Shuffle partitions that one task may take for it; each holds memory until the task ends.
TOGETHER = 16
#: A key is hot from this part of all rows on, so there are fewer than HOT hot keys; never below LEAST rows.
HOT, LEAST = 2048, 250
#: Rows from which on a table is not sent through the driver for a join.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URL, without a slash at its end."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        at = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="quernstone-"))
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/quernstone-{uuid.uuid4().hex}/{name}"
    _MADE.append((spark, path.rpartition("/")[0]))
    return path


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it was running, not
    the work of the stages before.  With an estimate of ``rows``, narrow ones,
    a small table takes a file for some ``TOGETHER`` shuffle partitions instead
    of one for each.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(-(-rows // FILE_ROWS), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // TOGETHER)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it is too small to be a task for each of them.

    A small table may be one block of one file, and so one task.  From a task's
    share of a scan for each core on, by the planner's estimate, ``df`` stays as
    it is: large tables are never shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    share = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if size < share * cores else df


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most about ``BATCH_BYTES``.

    The limit is a setting of the session and stays set: plans read it when
    they run.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def split_join(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "inner", rows: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` by ``key``, with the hot keys of ``left`` cut into pieces.

    ``right`` has one row for each key.  Rows of a hot key are dealt by
    ``spread``, a long, and that key's row of ``right`` goes to every piece.
    Which keys are hot is counted in ``rows``, a written table (``left`` if
    not given).
    """
    rows = left if rows is None else rows
    least = max(LEAST, rows.count() // HOT)
    hot = rows.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") > least) & F.col(key).isNotNull())
    hot = hot.select(key, F.ceil(F.col("n") / least).cast("int").alias("n")).collect()  # fewer than HOT rows
    if not hot:
        return left.join(right, key, how)
    piece, pieces = unused(left, "_piece"), unused(left, "_pieces")
    table = pa.table({key: [r[0] for r in hot], pieces: pa.array([r[1] for r in hot], pa.int32())})
    cut = F.broadcast(left.sparkSession.createDataFrame(table))
    dealt = left.join(cut, key, "left").withColumn(piece, F.pmod(spread, F.coalesce(pieces, F.lit(1))).cast("int")).drop(pieces)
    many = right.join(cut, key, "left").withColumn(piece, F.explode(F.sequence(F.lit(0), F.coalesce(pieces, F.lit(1)) - 1))).drop(pieces)
    return dealt.join(many, [key, piece], how).drop(piece)


def shuffled(df: DataFrame, wide: bool) -> DataFrame:
    """``df``, for joins that shuffle both sides if it is ``wide``, however small its files look to the planner."""
    return df.hint("merge") if wide else df


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@atexit.register
def _remove() -> None:
    for spark, path in _MADE:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended before
            return
