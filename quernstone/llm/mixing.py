"""Mixing sources to target weights, in DataFrame operations only.

Targets are the fixed point of capped weighted shares: a source whose weighted
share exceeds ``most`` times its size gets that cap, and the excess goes to the
others by weight.  Within a source, complete epochs come first; the rest of the
target is chosen by Efraimidis-Spirakis keys ``-ln(u) / weight`` in ascending
order, prefix-summed up to the budget.  The document at the boundary is taken
if that comes nearer to the target.

Rows equal in doc_id, source and text have one key.  They are counted before
keys are ranked, and where the budget ends among them, so many of them are taken
as fit.

No source is sorted in one task.  The keys are dealt into many ranges, spread
evenly by the source's mean key; the ranges' sums say in which one a source's
boundary lies; that range is cut again, and only the rows of the last small
range are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quernstone.workspace import is_empty, materialize, split_join, unused

WORDS = r"[^\x20\x09-\x0D]+"
#: The sources' weights, in code-point order of their names, repeating; null comes last.
WEIGHTS = (5.0, 2.0, 1.0)
RANGES = 1024
#: Sources in a file of a table with a row for each.
SOURCES = 100_000
#: Equal rows that are made anew by one task.
PIECE = 10_000


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """The default weight of a document, in (0, 1]: the share of letters and spaces in its text, at least 0.05.

    A caller with better scores, such as a classifier's, gives them as a column.
    """
    noise = F.regexp_count(text, F.lit(r"[^\p{L}\s.,]"))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.coalesce(noise / F.greatest(F.length(text), F.lit(1)), F.lit(0.0)))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sizes(source, source_size)``, a row for each source, with ``target``.

    The windows run over one row per source, after aggregation.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    # The first source that stays under its cap has the highest level of those that do.
    level = (F.col("total") - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    out = sizes.withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    out = out.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("level", level)
    out = out.withColumn("free", F.max(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))).over(everything))
    return out.select("source", "source_size", F.least("cap", F.coalesce(F.col("free") * F.col("weight"), F.col("cap"))).alias("target"))


def _cut(rows: DataFrame, key: str) -> DataFrame:
    """For each source the range of ``key`` that holds its boundary, and the sum before it."""
    sums = rows.groupBy("source", "rest", key).agg(F.sum("size").alias("part"))
    run = Window.partitionBy("source").orderBy(key)
    sums = sums.withColumn("upto", F.sum("part").over(run)).filter(F.col("upto") > F.col("rest"))
    return sums.groupBy("source").agg(F.min_by(F.struct(F.col(key), (F.col("upto") - F.col("part")).alias("before")), key).alias("cut"))


def row_key(seed: str) -> Column:
    """What a row's random key depends on: doc_id, source and text; null is not an empty string."""
    known = (F.coalesce(F.concat(F.lit(mark), F.col(c).cast("string")), F.lit("")) for mark, c in (("d", "doc_id"), ("s", "source")))
    return F.md5(F.concat_ws("|", F.lit(seed), *known, F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))


def repeated(rows: DataFrame, often: Column) -> DataFrame:
    """Each row so many times, in pieces that are dealt to all tasks."""
    many, piece, copy = (unused(rows, x) for x in ("_many", "_piece", "_copy"))
    out = rows.withColumn(many, often).filter(F.col(many) > 0)
    out = out.withColumn(piece, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(many) - 1) / PIECE)))).repartition(piece)
    here = F.least(F.col(many) - F.col(piece) * PIECE, F.lit(PIECE))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), here.cast("long")))).select(rows.columns)


def plan(docs: DataFrame, seed: str = "mix", share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, weight: Column | None = None) -> DataFrame:
    """How often each document is taken.

    ``docs(doc_id, text, source)`` gives ``doc_id, source, size, source_size,
    target, copies, row_key``.  ``weight`` is a column of ``docs``, taken as at
    least 1e-9.  The choice depends on doc_id, text and source only, so reruns
    agree whatever the partitioning.  Of rows equal in all three, at the boundary,
    some may be taken once more than the others.  Null and empty texts
    have size 0 and are never taken beyond the complete epochs; a null source
    is a source of its own, the last one.  A null doc_id takes part like any
    other value.  An empty table gives no rows.
    """
    chance = quality_weight(F.col("text")) if weight is None else F.greatest(weight.cast("double"), F.lit(1e-9))
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), chance.alias("w"), row_key(seed).alias("row_key"))
    unit = (F.conv(F.substring("row_key", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    narrow = materialize(narrow.withColumn("at", -F.log(unit) / F.col("w")).drop("w"), "keys")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("at").alias("mean"))
    sized = targets(sizes, share, most, weights).join(sizes.select(F.col("source").alias("s"), "mean"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    sized = materialize(sized, "targets", SOURCES)
    sized = sized.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    sized = sized.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    rests = sized.select(F.col("source").alias("s"), "rest", "source_size", "target", "epochs", "mean")
    keyed = narrow.join(rests, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # at / (at + mean) rises with at, lies in [0, 1) and spreads keys over the ranges; it orders nothing itself.
    keyed = keyed.withColumn("even", F.col("at") / (F.col("at") + F.col("mean")) * RANGES).drop("mean")
    keyed = keyed.withColumn("r1", F.least(F.floor("even"), F.lit(RANGES - 1)).cast("int"))
    keyed = keyed.withColumn("r2", F.floor((F.col("even") - F.col("r1")) * RANGES).cast("int")).drop("even")
    first = _cut(keyed, "r1").select(F.col("source").alias("s"), F.col("cut.r1").alias("c1"), F.col("cut.before").alias("b1"))
    first = materialize(first, "cut1", SOURCES)
    inner = keyed.join(first, F.col("source").eqNullSafe(F.col("s")) & (F.col("r1") == F.col("c1"))).drop("s")
    second = _cut(inner.withColumn("rest", F.col("rest") - F.col("b1")), "r2")
    second = materialize(second.select(F.col("source").alias("s"), F.col("cut.r2").alias("c2"), F.col("cut.before").alias("b2")), "cut2", SOURCES)
    inner = inner.join(second, F.col("source").eqNullSafe(F.col("s")) & (F.col("r2") == F.col("c2"))).drop("s")
    # Equal rows are one row here; of ``same`` of them the budget takes so many that it comes nearest to its end.
    tied = inner.groupBy("source", "at", "row_key").agg(F.count("*").alias("same"), F.max("size").alias("size"), F.max(F.col("rest") - F.col("b1") - F.col("b2")).alias("left"), F.max("c2").alias("c2"))
    run = Window.partitionBy("source").orderBy("at", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    ranked = tied.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("same")).over(run), F.lit(0)))
    fit = F.floor((F.col("left") - F.col("before")) / F.greatest("size", F.lit(1)) + F.lit(0.5))
    ranked = ranked.withColumn("take", F.least("same", F.greatest(fit, F.lit(0))).cast("long"))
    ends = ranked.filter("take > 0").groupBy("source").agg(F.max(F.struct("at", "row_key", "take", "same")).alias("end"))
    cuts = first.join(ranked.select(F.col("source").alias("s2"), "c2").distinct(), F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2")
    cuts = cuts.join(ends.withColumnRenamed("source", "s3"), F.col("s").eqNullSafe(F.col("s3")), "left").drop("s3")
    cuts = materialize(cuts.select("s", "c1", "c2", "end"), "cuts", SOURCES)
    out = keyed.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    below = (F.col("r1") < F.col("c1")) | ((F.col("r1") == F.col("c1")) & (F.col("r2") < F.col("c2")))
    place, end = F.struct("at", "row_key"), F.struct(F.col("end.at").alias("at"), F.col("end.row_key").alias("row_key"))
    at_cut = (F.col("r1") == F.col("c1")) & (F.col("r2") == F.col("c2")) & (place <= end)
    chosen = F.coalesce(below, F.lit(False)) | F.coalesce(at_cut, F.lit(False))
    some = F.coalesce(at_cut & (place == end) & (F.col("end.take") < F.col("end.same")), F.lit(False)) & (F.col("size") > 0)
    extra = F.when((F.col("rest") > 0) & (F.col("size") > 0) & chosen, 1).otherwise(0)
    copies = (F.col("epochs") + extra).cast("int").alias("copies")
    columns = ("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"))
    if is_empty(cuts.filter("end.take < end.same")):
        return out.select(*columns, copies, "row_key")
    # Equal rows, one group of them a source at most, of which a part is taken: made anew from their number.
    split = out.filter(some).groupBy("source", "row_key").agg(*(F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target", "epochs", "end")))
    parts = [repeated(split.withColumn("epochs", F.col("epochs") + more), often) for more, often in ((1, F.col("end.take")), (0, F.col("end.same") - F.col("end.take")))]
    parts = [part.select(*columns, F.col("epochs").cast("int").alias("copies"), "row_key") for part in parts]
    return out.filter(~some).select(*columns, copies, "row_key").union(parts[0]).union(parts[1])


def mix(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; its columns stay.

    Rows equal in doc_id, source and text are in the mix equally often, or, where
    the budget ends among them, some once more: those with the smallest hashes of
    all their columns.  Rows that share only some of the three, nulls included,
    are chosen by themselves.
    """
    key, often, copy, most, total, n = (unused(docs, x) for x in ("_key", "_often", "_copy", "_most", "_total", "_n"))
    planned = materialize(plan(docs, seed, **options).select(F.col("row_key").alias(key), F.col("copies").alias(often)), "plan")
    each = planned.groupBy(key).agg(F.min(often).alias(often), F.max(often).alias(most), F.sum(often).alias(total), F.count("*").alias(n))
    keyed = docs.withColumn(key, row_key(seed))
    out = split_join(keyed, each.filter(F.col(often) > 0).select(key, often), key, F.monotonically_increasing_id(), rows=planned)
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(often)))).select(docs.columns)
    uneven = materialize(each.filter(F.col(most) > F.col(often)).select(key, (F.col(total) - F.col(often) * F.col(n)).alias(total)), "uneven", SOURCES)
    if is_empty(uneven):
        return out
    whole, row, hash_ = F.struct(*docs.columns), unused(docs, "_row"), unused(docs, "_hash")
    same = keyed.join(uneven, key).groupBy(key, F.xxhash64(F.to_json(whole)).alias(hash_)).agg(F.first(whole).alias(row), F.count("*").alias(n), F.max(total).alias(total))
    before = F.coalesce(F.sum(n).over(Window.partitionBy(key).orderBy(hash_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = same.select(row, F.least(F.col(n), F.greatest(F.col(total) - before, F.lit(0))).alias(often))
    return out.union(repeated(more, F.col(often)).select(f"{row}.*"))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = plan(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies")
