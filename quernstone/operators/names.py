"""A stored index of names by their trigrams, for look-ups of a part of a name.

A name is in the posting list of each trigram of its lower case, filled up at its
end so that each place begins one.  A name that contains a text contains all of
the text's trigrams, so the lists of the text's rarest ones, as the index counts
them, hold every name in question, and few others; these are compared in full.
A text of one or two characters has no trigram: it takes the lists of all
trigrams that begin with it.

Lists are sorted by trigram within their files, so a search reads the blocks of
its trigrams alone.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quernstone.workspace import materialize, new_path

#: Trigrams of a text that are looked up, and how many may be sent to all tasks and to the scan as a filter.
PROBES, SENT, LISTED = 2, 50_000, 2_000
_END = "\x01\x01"


class NameIndex(NamedTuple):
    """``names(node, label, key, name, low)``, ``postings(gram, node)`` sorted by gram, and ``grams(gram, df)``."""

    names: DataFrame
    postings: DataFrame
    grams: DataFrame


def trigrams(text: Column, end: str = "") -> Column:
    """The distinct trigrams of a text that is followed by ``end``; none if it is too short."""
    size = F.length(text) + len(end) - 2
    padded = F.concat(text, F.lit(end))
    return F.when(size > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def build_names(nodes: DataFrame, path: str | None = None, only: DataFrame | None = None) -> NameIndex:
    """Write the index of ``nodes(label, key, name)`` under ``path``, or for this session into the shared folder.

    A null name is none.  For a single search the lists may be those of the grams
    that begin with one of ``only(start)``, of up to three characters.
    """
    spark = nodes.sparkSession
    path = path or new_path(spark, "names")
    named = nodes.filter("name IS NOT NULL").select("label", "key", "name").distinct()
    named.withColumns({"low": F.lower("name"), "node": F.monotonically_increasing_id()}).write.parquet(f"{path}/names")
    names = spark.read.parquet(f"{path}/names")
    each = names.select(F.explode(trigrams(F.col("low"), _END)).alias("gram"), "node")
    if only is not None:
        starts = [each.join(F.broadcast(only.filter(F.length("start") == n)), F.substring("gram", 1, n) == F.col("start"), "left_semi") for n in (1, 2, 3)]
        each = starts[0].union(starts[1]).union(starts[2]).distinct()
    each.repartition("gram").sortWithinPartitions("gram").write.parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    postings.groupBy("gram").agg(F.count("*").alias("df")).sortWithinPartitions("gram").write.parquet(f"{path}/grams")
    return read_names(spark, path)


def read_names(spark: SparkSession, path: str) -> NameIndex:
    """The index that ``build_names`` wrote under ``path``."""
    return NameIndex(*(spark.read.parquet(f"{path}/{part}") for part in ("names", "postings", "grams")))


def starts(texts: DataFrame) -> DataFrame:
    """``start``: what the grams of ``texts(low)`` begin with: their trigrams, or a short text itself."""
    grams = F.when(F.length("low") < 3, F.array("low")).otherwise(trigrams(F.col("low")))
    return texts.filter("low <> ''").select(F.explode(grams).alias("start")).distinct()


def _probes(index: NameIndex, texts: DataFrame) -> DataFrame:
    """``low, gram, need``: the grams to look up for each text, and how many of them a name must have."""
    long = texts.filter(F.length("low") >= 3).select("low", F.explode(trigrams(F.col("low"))).alias("gram"))
    counted = long.join(index.grams, "gram", "left").fillna(0, ["df"])
    rarest = counted.withColumn("place", F.row_number().over(Window.partitionBy("low").orderBy("df", "gram"))).filter(F.col("place") <= PROBES)
    need = F.count("*").over(Window.partitionBy("low"))
    rare = rarest.select("low", "gram", need.alias("need"))
    out = rare
    for n in (1, 2):
        short = texts.filter(F.length("low") == n).select("low", F.col("low").alias("start"))
        out = out.union(index.grams.withColumn("start", F.substring("gram", 1, n)).join(short, "start").select("low", "gram", F.lit(1).cast("long")))
    return out


def containing(index: NameIndex, texts: DataFrame) -> DataFrame:
    """``low, label, key, name``: each name that contains a text of ``texts(low)``, lower-cased.

    The empty text and null are in no name.
    """
    texts = texts.select("low").filter("low <> ''").distinct()
    probes = materialize(_probes(index, texts), "probes")
    n = probes.count()
    postings = index.postings
    if n <= LISTED:
        postings = postings.filter(F.col("gram").isin([r["gram"] for r in probes.select("gram").distinct().collect()]))
    met = postings.join(F.broadcast(probes) if n <= SENT else probes, "gram")
    # A node that has one of two grams only is no candidate; counted before its name is read.
    both = met.groupBy("low", "node").agg(F.count("*").alias("have"), F.max("need").alias("need")).filter((F.col("have") >= F.col("need")) | (F.length("low") < 3))
    return both.join(index.names, "node").filter(F.contains(index.names["low"], both["low"])).select(both["low"], "label", "key", "name")
