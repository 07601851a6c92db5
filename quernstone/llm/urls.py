"""URL filters: rules first, then propagation over the link graph of hosts.

A rule is a host suffix and a path prefix; the longest that fits a url decides.
Pages without a rule get the verdict of their host.  Personalised PageRank
carries trust from hosts with allowed pages along the links, and distrust from
hosts with blocked pages against the links (who links to a blocked host is
suspect).  A host whose distrust exceeds ``ratio`` times its trust is blocked.

A rank is ``r = (1 - d) * seed + d * sum over links of r / links out``, carried
on until no host is new and no rank changes by more than ``SETTLED`` of itself;
what reaches a host without links stays there.
Seeds of a kind share a total of 1, by their numbers of pages.  Both
kinds move in one job per round; links are counted once per pair of hosts
before anything moves, so a host with very many links is aggregated first.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from quernstone.workspace import is_empty, materialize, split_join

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Ranks have settled when none is new and none changes by more than this part of itself in four rounds.
SETTLED = 1e-10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?is)<a\s[^>]*?href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for name, prefix, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts, ``(src, dst, n)``, from ``pages(host, html)``.

    Relative links stay on their host and give no edge.
    """
    links = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), 1))).alias("to"))
    links = links.select(F.col("host").alias("src"), host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to"))).alias("dst"))
    return links.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = 0.85) -> DataFrame:
    """``host, trust, distrust`` from ``edges(src, dst, n)`` and ``seeds(host, trust, distrust)``.

    Without a number of ``rounds`` they go on until the ranks have settled.
    """
    if is_empty(edges):
        return seeds.select("host", *((F.col(c) * (1 - damping)).alias(c) for c in ("trust", "distrust")))
    n = edges.count()
    forward = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n")
    both = forward.union(edges.select(F.lit("distrust"), "dst", "src", "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    moves = materialize(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("out")).alias("part")), "moves", 2 * n)
    base = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "seed")).filter("seed > 0")
    base = materialize(base.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank")), "seeds", 2 * seeds.count())
    rank = last = base
    for k in count() if rounds is None else range(rounds):
        moved = moves.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("part") * damping).alias("rank"))
        rank = base.union(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if k % 4 == 3 or k + 1 == rounds:
            rank = materialize(rank, "rank", 4 * n)
            if rounds is None:
                before = last.select("kind", "host", F.col("rank").alias("was"))
                if is_empty(rank.join(before, ["kind", "host"], "left").filter(F.col("was").isNull() | (F.col("rank") - F.col("was") > SETTLED * F.col("rank")))):
                    break
                last = rank
    pick = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(pick("trust"), pick("distrust"))


def judge(pages: DataFrame, rules=RULES, ratio: float = 1.0, rounds: int | None = None, damping: float = 0.85) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust``, a row for each row.

    ``pages(page_id, url, html)``.  A null url, and one without ``://``, has an
    empty host and path; no rule fits it, no link reaches it, and it is
    allowed.  A null or empty html has no links, a very long one gives all of
    its.  Without a link to a seed both ranks are 0 and the page is allowed.
    Repeated rows are judged alike, and each counts; an empty table gives no
    rows.
    """
    page = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    page = page.withColumn("rule", rule).withColumn("says", says)
    edges = materialize(host_edges(page), "edges", page.count())
    seeds = page.filter("host <> '' AND says IS NOT NULL").groupBy("host").agg(*(F.sum(F.when(F.col("says") == s, 1.0).otherwise(0.0)).alias(c) for c, s in (("trust", "allow"), ("distrust", "block"))))
    seeds = materialize(seeds, "counts", page.count())
    total = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).head()
    seeds = seeds.select("host", (F.col("trust") / max(total["t"] or 0.0, 1.0)).alias("trust"), (F.col("distrust") / max(total["d"] or 0.0, 1.0)).alias("distrust"))
    ranks = materialize(propagate(edges, seeds, rounds, damping), "ranks", seeds.count() + 2 * edges.count()).filter("host <> ''")
    page = materialize(page.drop("html").withColumn("row", F.monotonically_increasing_id()), "judged")
    out = split_join(page, ranks, "host", F.col("row"), "left").fillna(0.0, ["trust", "distrust"])
    verdict = F.coalesce("says", F.when(F.col("distrust") > F.col("trust") * ratio, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def op8(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})
