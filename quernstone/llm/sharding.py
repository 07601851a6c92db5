"""Sharding by vector bin packing.

Rows with equal texts form a group; a group has a vector of bytes, tokens and
rows.  Groups are placed, largest first, into the shard whose residual capacity
has the highest dot product with the group's vector, each dimension measured in
mean shard loads.

Every group is placed so.  Groups of at least 1 / ``ALONE`` of a mean shard, of
which there are few, are placed first, on the driver.  What they leave of each
shard is divided among parts of about ``PART`` of the other groups, and each
part fills its share of the shards in a task of its own; the sums of shares
filled alike are alike.  A group larger than a shard cannot stay whole under
near-equal loads; its rows are dealt to as many pieces as it has shards' worth
of bytes, times four.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quernstone.llm.mixing import word_count
from quernstone.workspace import materialize, split_join, unused

ALONE = 256
PART = 20_000
#: Rows that one window numbers.
SLICE = 20_000
#: Bytes, tokens and rows in the dot product; bytes first, as their balance is the law.
WEIGHTS = (4.0, 1.0, 1.0)


def place(need: np.ndarray, left: np.ndarray, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of each vector, by the highest weighted dot product with what is ``left`` of the shards.

    Both are in mean shard loads; ``left`` is lowered by what is placed.
    """
    scale = np.asarray(weights)
    out = np.zeros(len(need), np.int32)
    for i in np.argsort(-(need * np.sqrt(scale)).max(1), kind="stable"):
        out[i] = s = int(np.argmax(left @ (need[i] * scale)))
        left[s] -= need[i]
    return out


def _packed(groups: DataFrame, mean: np.ndarray, left: np.ndarray, parts: int) -> DataFrame:
    """``h, shard`` of ``groups(h, bytes, tokens, rows)``, each part of them by itself."""
    shards = len(left)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        turn = int(rows["part"].iloc[0]) * shards // parts  # ties go to other shards in each part
        rows = rows.sort_values("h")
        found = place(rows[["bytes", "tokens", "rows"]].to_numpy(float) / mean, np.roll(left / parts, turn, 0))
        return pd.DataFrame({"h": rows["h"], "shard": ((found - turn) % shards).astype(np.int32)})

    dealt = groups.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "h"), F.lit(parts)))
    return dealt.groupBy("part").applyInPandas(pack, "h long, shard int")


def assign(docs: DataFrame, shards: int = 40, whole: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes plus 16; a null text has none and forms
    its group with the empty text.  Slots run gapless from 0 in each shard.
    Repeated rows and rows with a null doc_id are rows of their own.  A very
    long text counts whole.  With ``whole`` all columns of ``docs`` come first,
    and names that they have are made longer.  An empty table gives no rows.
    """
    spark, rid = docs.sparkSession, unused(docs, "_rid")
    if whole:
        docs = materialize(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")
    row = F.col(rid) if whole else F.monotonically_increasing_id()
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        word_count(text).alias("tokens"),
        F.xxhash64(text).alias("h"),
        row.alias("row"),
    )
    narrow = materialize(narrow, "narrow")
    total = narrow.agg(*(F.coalesce(x, F.lit(0)).cast("double") for x in (F.sum("size"), F.sum("tokens"), F.count("*")))).head()
    mean = np.maximum(np.array(total[:3]) / shards, 1e-9)
    groups = narrow.groupBy("h").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    pieces = F.when(F.col("bytes") > mean[0], F.least(F.col("rows"), F.ceil(F.col("bytes") * 4 / mean[0]))).otherwise(1).cast("long")
    groups = materialize(groups.withColumn("pieces", pieces), "groups")
    # Groups cut into pieces are fewer than the shards.  Where one doc_id or null has many rows of one, ids can't deal them.
    cut = groups.filter("pieces > 1").select("h", "pieces")
    often = narrow.join(F.broadcast(cut), "h").groupBy("h", "doc_id").count().groupBy("h").agg(F.max("count").alias("most"))
    cut = materialize(cut.join(often, "h").select("h", "pieces", (F.col("most") == 1).alias("ids")), "cut", shards)
    keyed = narrow.join(F.broadcast(cut), "h", "left")
    deal = F.when(F.col("ids"), F.xxhash64(F.lit("row"), "doc_id")).otherwise(F.xxhash64(F.lit("row"), "row"))
    keyed = keyed.withColumn("piece", F.when(F.col("pieces").isNotNull(), F.pmod(deal, F.col("pieces"))))
    keyed = materialize(keyed.withColumn("item", F.coalesce(F.when(F.col("piece") > 0, F.xxhash64("h", "piece")), F.col("h"))).drop("pieces", "piece", "ids"), "keyed")
    sums = keyed.join(F.broadcast(cut.select("h")), "h", "left_semi").groupBy("item").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    large = (F.col("bytes") >= mean[0] / ALONE) | (F.col("rows") >= mean[2] / ALONE)
    alone = groups.filter((F.col("pieces") == 1) & large).select(F.col("h").alias("item"), "bytes", "tokens", "rows")
    alone = alone.union(sums).orderBy("item").toPandas()  # at most some 2 * ALONE + 4 for each shard
    left = np.ones((shards, 3))
    first = place(alone[["bytes", "tokens", "rows"]].to_numpy(float).reshape(-1, 3) / mean, left)
    known = pa.table({"h": pa.array(alone["item"], pa.int64()), "shard": pa.array(first, pa.int32())})
    small = groups.filter((F.col("pieces") == 1) & ~large).select("h", "bytes", "tokens", "rows")
    parts = max(1, -(-small.count() // PART))
    where = materialize(_packed(small, mean, left, parts).union(spark.createDataFrame(known)), "where").withColumnRenamed("h", "item")
    placed = split_join(keyed, where, "item", F.col("row"))
    slices = max(1, int(-(-mean[2] // SLICE)))
    placed = placed.withColumn("slice", F.pmod(F.xxhash64(F.lit("slice"), "doc_id", "h", F.when(F.col("doc_id").isNull(), F.col("row"))), F.lit(slices)))
    placed = materialize(placed.select("row", "doc_id", "size", "text_crc32", "shard", "slice", "h"), "placed")
    starts = placed.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    starts = starts.withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("shard", "slice").orderBy(F.col("doc_id").asc_nulls_last(), "h", "row")) - 1
    out = placed.withColumn("place", inside).join(starts, ["shard", "slice"]).withColumn("slot", (F.col("start") + F.col("place")).cast("long"))
    names = ("size", "text_crc32", "shard", "slot")
    if not whole:
        return out.select("doc_id", *names)
    new = {c: unused(docs, c) for c in names}
    return docs.join(out.select(F.col("row").alias(rid), *(F.col(c).alias(new[c]) for c in names)), rid).drop(rid)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = assign(docs, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
