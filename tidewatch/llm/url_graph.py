"""URL filter: rules first, then trust and distrust propagated over the graph of hosts.

Hosts whose pages the rules allow are trusted seeds, hosts whose pages they block are blocked seeds; the seed weight is
the number of such pages, so a host may be both. Trust follows the links (personalised PageRank), distrust goes against
them, since whoever links to a blocked host is suspect. A host is blocked when its distrust exceeds ``threshold`` times
its trust. Everything is DataFrame operations: the graph has a row per pair of hosts, both scores move in one join and
one pre-aggregated sum per round, and each round is written below the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import staged

# (verdict, host, path): fixed values of the contract
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# a tag ends where the next begins, so broken pages are read once
LINK = r"(?is)<a\s[^<>]*?href\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Among equally long rules the first counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted. Relative links stay within their host."""
    links = pages.where(F.col("html").contains("//")).select(
        url_host(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    target = F.regexp_replace(F.col("link"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "x://")
    hosts = links.select("src", url_host(target).alias("dst"))
    return hosts.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_scores(
    pages: DataFrame, rules=RULES, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 10_000
) -> DataFrame:
    """(host, trust, distrust) of every host with a score; stops when no score moves by more than ``tolerance`` of itself.

    A host that is reached for the first time moves by all of its score. When all scores move by less than a part of
    themselves, so they do in every later round, as a round only adds up shares of the moves before. An error is raised
    when ``rounds`` don't suffice.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    seen = pages.select(host.alias("host"), ruled(host, path, rules)[1].alias("verdict")).where("host <> '' AND verdict IS NOT NULL")
    seeds = staged(seen.groupBy("host", "verdict").agg(F.count("*").alias("n")).select(
        "host", (F.col("verdict") == "block").cast("int").alias("kind"), ((1 - damping) * F.col("n")).alias("seed")), "seeds")
    edges = staged(host_edges(pages), "edges")
    out = edges.groupBy("src").agg(F.sum("n").alias("all")).select(F.col("src").alias("s"), "all")
    into = edges.groupBy("dst").agg(F.sum("n").alias("all")).select(F.col("dst").alias("d"), "all")
    flow = staged(
        edges.join(out, F.col("src") == F.col("s")).select(F.col("src").alias("from"), F.col("dst").alias("to"), F.lit(0).alias("k"), (F.col("n") * damping / F.col("all")).alias("share"))
        .unionByName(edges.join(into, F.col("dst") == F.col("d")).select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(1).alias("k"), (F.col("n") * damping / F.col("all")).alias("share"))),
        "flow")
    scores = seeds.select("host", "kind", F.col("seed").alias("score"))
    if seeds.limit(1).count() and flow.limit(1).count():
        for _ in range(rounds):
            moved = flow.join(scores, (F.col("from") == F.col("host")) & (F.col("k") == F.col("kind"))).select(
                F.col("to").alias("host"), "kind", (F.col("share") * F.col("score")).alias("x"), F.lit(0.0).alias("was"))
            parts = moved.unionByName(seeds.select("host", "kind", F.col("seed").alias("x"), F.lit(0.0).alias("was"))).unionByName(
                scores.select("host", "kind", F.lit(0.0).alias("x"), F.col("score").alias("was")))
            new = staged(parts.groupBy("host", "kind").agg(F.sum("x").alias("score"), F.sum("was").alias("was")), "scores")
            moving = new.where(F.abs(F.col("score") - F.col("was")) > tolerance * F.col("score")).limit(1).count()
            scores = new.select("host", "kind", "score")
            if not moving:
                break
        else:
            raise RuntimeError(f"host scores still move after {rounds} rounds")
    return scores.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == 1, F.col("score")).otherwise(0.0)).alias("distrust"))


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = 2.0, damping: float = 0.85, rounds: int = 10_000) -> DataFrame:
    """``pages`` with ``url_filter`` (host, path, rule, verdict).

    A rule fits its host and all subdomains when the path starts with the rule's; the longest decides. Where none fits,
    the host's scores decide: block when distrust > ``threshold`` * trust, else allow. Hosts without a score, null urls
    and urls without ``://`` (host and path empty) are allowed. Null html has no links. Repeated rows count as often as
    they occur. Other columns pass through; columns named like the result's are kept, the result being one struct.
    """
    scores = staged(host_scores(pages, rules, damping, rounds=rounds).select(
        F.col("host").alias("__host"), (F.col("distrust") > threshold * F.col("trust")).alias("__blocked")), "hosts")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    judged = pages.withColumn("__own", host).join(scores, F.col("__own") == F.col("__host"), "left")
    rule, verdict = ruled(host, path, rules)
    other = F.when(F.coalesce("__blocked", F.lit(False)), "block").otherwise("allow")
    result = F.struct(host.alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(verdict, other).alias("verdict"))
    return judged.withColumn("url_filter", result).drop("__own", "__host", "__blocked")


def query(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages).select("page_id", "url_filter.*")
