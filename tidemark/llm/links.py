"""URL filters by trust and distrust over the host graph (operator 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

DAMPING = 0.85
#: A page goes if so large a share of its host's links, discounted by their distance, leads to blocked hosts,
#: unless at least LEAST_BACKING, and more than that, of the links to its host comes from trusted ones.
MOST_BAD_LINKS = 0.01
LEAST_BACKING = 0.1
TOLERANCE = 1e-7

_HOST = r"(?i)^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+)"
_SITE = r"^(?:www\d?|m|mobile|amp|blog|blogs|news|old|en|de|es|fr)\.((?:[^.]+\.)+[^.]+)$"
_LINK = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """The host of an absolute or protocol-relative URL in lower case, without a last dot; null for others."""
    found = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", "")
    return F.when(found != "", found)


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and weight (number of links) of the host graph.

    A link is the href of an <a>; one without a host leads to the page's own.  Besides, a host with one
    of the usual prefixes (www, m, blog and the like) and the host without it have a link of weight 1 each way.
    """
    hosts = pages.select(host_of(F.col("url")).alias("src"), "html").where("src is not null")
    links = hosts.select("src", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))).alias("link"))
    links = links.groupBy("src", F.coalesce(host_of(F.col("link")), F.col("src")).alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    parent = F.regexp_extract("src", _SITE, 1)
    named = hosts.select("src").unionByName(links.select(F.col("dst").alias("src"))).distinct()
    up = named.select("src", parent.alias("dst")).where("dst <> ''")
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def listed(hosts: DataFrame, names: list[str]) -> DataFrame:
    """The rows of hosts that are listed: a name without a dot is any label of a host but the last, one with a dot is the host or a domain above it."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.concat(F.slice(labels, 1, F.size(labels) - 1), F.filter(above, lambda x: x.contains(".")))
    wanted = hosts.sparkSession.createDataFrame([(n,) for n in sorted({n.lower().strip(".") for n in names})], "part string")
    found = hosts.select("host", F.explode(parts).alias("part")).join(common.maybe_broadcast(wanted, 500_000), "part", "left_semi")
    return found.select("host").distinct()


def reach(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """walk, host and score: the part of the host's personalised PageRank that seeds (walk, host) hold.

    The walk from a host goes on with chance `damping` along one of its links by weight, and stays at a seed once it is there; its PageRank,
    summed up over the seeds, is 1 for a seed and for others `damping` times the mean of the scores that its links lead to.
    It is found for all hosts at once by sending scores from the seeds back along the links.

    Edges have walk, src, dst and weight; links of a host to itself don't count, and hosts that reach no seed are left out.  A host's
    score depends on where its own links lead, not on the number of hosts or seeds.  Steps go on until no score changes by more than
    `tolerance`, each checkpointed; scores only grow, and each step's largest change is at most `damping` times that of the one before.
    """
    spark = edges.sparkSession
    edges = edges.where("src <> dst")
    total = edges.groupBy("walk", "src").agg(F.sum("weight").alias("out"))
    moves = edges.join(total, ["walk", "src"]).select("walk", "src", F.col("dst").alias("host"), (F.col("weight") / F.col("out") * damping).alias("share"))
    fixed = common.cut(spark, seeds.select("walk", "host").where("host is not null").distinct())
    moves = common.cut(spark, moves.join(fixed.select("walk", F.col("host").alias("src")), ["walk", "src"], "left_anti"))
    ones = fixed.withColumn("score", F.lit(1.0))
    score = ones
    while True:
        moved = score.join(moves, ["walk", "host"]).groupBy("walk", F.col("src").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("score"))
        new = common.cut(spark, ones.unionByName(moved))
        old = score.select("walk", "host", F.col("score").alias("old"))
        change = new.join(old, ["walk", "host"], "left").agg(F.max(F.col("score") - F.coalesce("old", F.lit(0.0)))).first()[0]
        score = new
        if (change or 0.0) <= tolerance:
            return score


def filter_urls(pages: DataFrame, trusted: list[str], blocked: list[str], most_bad_links: float = MOST_BAD_LINKS, least_backing: float = LEAST_BACKING, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, trust, distrust and keep for each row of pages, with hosts listed as in `listed`.

    Distrust is the share of a host's links that lead to blocked hosts, trust that of the links to it which come from trusted ones, both
    discounted by distance as in reach.  Pages of blocked hosts always go, also if trusted.  Others go if their distrust is at
    least `most_bad_links`, unless trust is at least `least_backing` and more than distrust; hosts without scores stay.

    A URL without a host, a null or an empty one has null host and scores, and keep is false.  Null html has no links; a host
    without any has scores of 0 unless it is listed.
    Repeated rows count each, and null page_ids are kept.  Columns besides page_id, url and html are not looked at.
    """
    spark = pages.sparkSession
    edges = common.cut(spark, host_edges(pages))
    out = edges.select(F.lit("distrust").alias("walk"), "src", "dst", "weight")
    into = edges.select(F.lit("trust").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    hosts = edges.select(F.explode(F.array("src", "dst")).alias("host")).unionByName(pages.select(host_of(F.col("url")).alias("host"))).where("host is not null").distinct()
    hosts = common.cut(spark, hosts)
    bad = common.cut(spark, listed(hosts, blocked))
    good = listed(hosts, trusted).join(bad, "host", "left_anti")
    seeds = bad.select(F.lit("distrust").alias("walk"), "host").unionByName(good.select(F.lit("trust").alias("walk"), "host"))
    of = lambda walk: F.coalesce(F.max(F.when(F.col("walk") == walk, F.col("score"))), F.lit(0.0)).alias(walk)
    scores = reach(out.unionByName(into), seeds, damping, tolerance).groupBy("host").agg(of("trust"), of("distrust"))
    scores = scores.join(bad.withColumn("bad", F.lit(True)), "host", "left")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"))
    done = rows.join(common.maybe_broadcast(common.cut(spark, scores), 500_000), "host", "left")
    known = F.col("host").isNotNull()
    done = done.select("page_id", "host", *[F.when(known, F.coalesce(c, F.lit(0.0))).alias(c) for c in ("trust", "distrust")], F.coalesce("bad", F.lit(False)).alias("bad"))
    backed = (F.col("trust") >= least_backing) & (F.col("trust") > F.col("distrust"))
    keep = ~F.col("bad") & ((F.col("distrust") < most_bad_links) | backed)
    return done.select("page_id", "host", "trust", "distrust", F.coalesce(keep, F.lit(False)).alias("keep"))
