"""URL filtering: rules on hosts and paths, and for the rest link-graph propagation between hosts.

Trust flows along the links from hosts that allow rules cover, distrust flows against the links from hosts that block
rules cover; both are personalised PageRanks over host edges, in Spark, and a host's threshold on the two decides about
its pages without a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

#: Links with a host of their own, in double, single or no quotes.
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty without ``://``; A-Z of the host lower-cased."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rules(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add rule and rule_verdict (null where none fits): the longest rule wins, then the first in alphabetical order.

    rules: (verdict, host, path) — a stated list, like a query set; pages must have host and path.
    """
    best = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        best, verdict = F.when(fits, host + path).otherwise(best), F.when(fits, kind).otherwise(verdict)
    return pages.withColumns({"rule": best, "rule_verdict": verdict})


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, share: the share of a host's links to other hosts that goes to dst. Links are counted per pair first."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.withColumn("dst", F.translate("dst", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).filter("src <> dst and src <> ''")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


#: Propagation ends where a round moves less mass than this in all (L1) and reaches no host that had none.
TOLERANCE = 1e-12


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: kind, host, mass when a round's L1 change is below ``tolerance`` and no new host is reached.

    edges: kind, src, dst, share. seeds: kind, host, weight (sum 1 for each kind). Mass at a host without links is lost.
    Every round is written, so no lineage grows; a hub brings one row of mass to its edges, and the edges can be split.
    A number of ``rounds`` ends it earlier. The change falls by damping each round at least, so it ends.
    """
    start = seeds.select("kind", "host", ((1 - damping) * F.col("weight")).alias("mass"))
    now = materialize(start, "rank-0")
    if not edges.head(1):
        return now
    i = 0
    while rounds is None or i < rounds:
        i += 1
        moved = edges.join(now.select("kind", F.col("host").alias("src"), "mass"), ["kind", "src"])
        moved = moved.groupBy("kind", "dst").agg((damping * F.sum(F.col("mass") * F.col("share"))).alias("mass"))
        parts = start.select("kind", "host", "mass", F.lit(0.0).alias("old")).unionByName(moved.select("kind", F.col("dst").alias("host"), "mass", F.lit(0.0).alias("old")))
        parts = parts.unionByName(now.select("kind", "host", F.lit(0.0).alias("mass"), F.col("mass").alias("old")))
        now = materialize(parts.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("old").alias("old")), f"rank-{i}")
        change = now.agg(F.sum(F.abs(F.col("mass") - F.col("old"))).alias("l1"), F.count_if((F.col("old") == 0) & (F.col("mass") > 0)).alias("new")).first()
        if (change["l1"] or 0.0) < tolerance and not change["new"]:
            break
    return now.select("kind", "host", "mass")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], ratio: float = 1.0, damping: float = 0.85, rounds: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), trust and distrust of the host.

    pages: page_id, url, html. Seeds weigh as their host's share of all pages that allow rules (trust) or block rules
    (distrust) cover. A page without a rule is blocked if its host's distrust is over ``ratio`` times its trust; hosts
    that neither reaches are allowed. Null urls have empty hosts and no rule; null html has no links. Every row is judged
    for itself, so repeated rows stay; other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    judged = match_rules(rows, rules)
    counted = materialize(judged.filter("rule is not null").groupBy("host", "rule_verdict").agg(F.count(F.lit(1)).alias("n")), "seeds")
    totals = {r["rule_verdict"]: r["n"] for r in counted.groupBy("rule_verdict").agg(F.sum("n").alias("n")).collect()}  # two rows
    weight = F.col("n") / F.when(F.col("rule_verdict") == "allow", totals.get("allow", 1)).otherwise(totals.get("block", 1))
    seeds = counted.select(F.when(F.col("rule_verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host", weight.alias("weight"))
    links = materialize(host_edges(rows), "host-links")
    ways = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = ways.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    edges = materialize(ways.join(materialize(out, "host-degrees"), ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")), "host-edges")
    ranks = propagate(edges, seeds, damping, rounds)
    sums = {k: F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")}
    hosts = materialize(ranks.groupBy("host").agg(*sums.values()), "host-verdicts")
    final = judged.drop("html").join(hosts, "host", "left").withColumns({k: F.coalesce(k, F.lit(0.0)) for k in sums})
    method = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return final.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "trust", "distrust")
