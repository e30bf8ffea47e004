"""URL filtering: listed rules, and link-graph propagation for everything they leave open.

DataFrame functions only. A rule (host, path) fits its host and all subdomains of it where the url's
path starts with the rule's path; the longest fitting rule decides. Hosts with most pages allowed by rules seed
trust, hosts with most pages blocked seed distrust. Trust flows along links (personalised PageRank
from the trusted seeds), distrust flows against them (personalised PageRank on the reversed edges from
the blocked seeds: who links to blocked hosts is distrusted). A page without a rule is blocked when its
host's share of distrust exceeds ``threshold``; hosts without any evidence are allowed.

Links are aggregated to weighted host edges before anything is joined, and ranks are tables over hosts
that are written to the shared folder every few rounds. What has no outgoing edge returns its score to
nobody: scores are compared per host, so their sum doesn't matter. Rounds go on until the scores stand still.

Nulls, ties and repeated rows: a null url, or one without ``://``, has an empty host and path, no rule,
no links, and is allowed. Null or empty html has no links; a page of any length is read whole. Links are absolute ``href`` and
``src`` values. Links to the same host and relative links are not
edges. Repeated pages count twice. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch
from tessera.llm.skew import heavy_keys, keyed_join

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DAMPING, EACH, TOLERANCE = 0.85, 4, 1e-3
THRESHOLD = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest fitting rule; nulls where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, weight: links between different hosts, counted before the shuffle."""
    links = F.expr(f"""regexp_extract_all(coalesce(`{html}`, ''), '(?i)\\\\b(?:href|src)\\\\s*=\\\\s*["\\']?\\\\s*((?:https?:)?//[^"\\'\\\\s>]+)', 1)""")
    rows = pages.select(host_of(pages[url]).alias("src"), F.explode(links).alias("link"))
    target = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link")))
    return rows.select("src", target.alias("dst")).filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def _propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """(side, host, score): trust along the edges from allowed seeds, distrust against them from blocked ones.

    Rounds go on until ``EACH`` more of them move less than ``TOLERANCE`` of the scores and reach no further host.
    """
    node = lambda side, host: F.concat_ws(" ", F.lit(side), host).alias("node")
    two = edges.select(node("allow", "src"), F.lit("allow").alias("side"), F.col("dst").alias("to"), "weight").unionByName(edges.select(node("block", "dst"), F.lit("block").alias("side"), F.col("src").alias("to"), "weight"))
    links = two.count()
    if not links:
        return seeds
    # which nodes are hubs doesn't change with the rounds
    heavy = heavy_keys(two, "node", links)
    out = two.groupBy("node").agg(F.sum("weight").alias("total"))
    flow = keyed_join(two, out, "node", heavy=heavy).select("node", "side", "to", (F.col("weight") / F.col("total")).alias("share"))
    flow = scratch.table(flow, "flow")
    ranks, step = seeds, 0
    while True:
        before = ranks
        for _ in range(EACH):
            here = ranks.select(F.concat_ws(" ", "side", "host").alias("node"), "score")
            moved = keyed_join(flow, here, "node", heavy=heavy).select("side", F.col("to").alias("host"), (F.lit(DAMPING) * F.col("share") * F.col("score")).alias("score"))
            ranks = moved.unionByName(seeds.select("side", "host", ((1 - DAMPING) * F.col("score")).alias("score"))).groupBy("side", "host").agg(F.sum("score").alias("score"))
        step += EACH
        ranks = scratch.table(ranks, f"ranks-{step}")
        both = ranks.join(before.withColumnRenamed("score", "was"), ["side", "host"], "left")
        change = both.agg(F.sum(F.abs(F.col("score") - F.coalesce("was", F.lit(0.0)))).alias("moved"), F.count_if(F.col("was").isNull()).alias("new")).first()
        if step > EACH:
            scratch.drop(f"ranks-{step - EACH}")
        if not change["new"] and (change["moved"] or 0) <= TOLERANCE:
            return ranks


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, distrust of every page."""
    scratch = Scratch(pages.sparkSession, "url-filter")
    edges = scratch.table(host_edges(pages, url, html), "edges")
    judged = pages.select(pages[page_id].cast("long").alias("page_id"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("rule", name).withColumn("listed", verdict)
    hosts = judged.filter("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("listed") == "allow").alias("allowed"), F.count_if(F.col("listed") == "block").alias("blocked"))
    hosts = scratch.table(hosts, "hosts")
    seeds = hosts.select("host", F.when(F.col("allowed") * 2 > F.col("pages"), "allow").when(F.col("blocked") * 2 > F.col("pages"), "block").alias("side")).filter("side is not null")
    totals = F.broadcast(seeds.groupBy("side").agg(F.count("*").alias("n")))  # two rows at most
    seeds = scratch.table(seeds.join(totals, "side").select("side", "host", (1 / F.col("n")).alias("score")), "seeds")
    ranks = _propagate(edges, seeds, scratch)
    share = ranks.groupBy("host").agg(F.sum(F.when(F.col("side") == "block", F.col("score")).otherwise(0.0)).alias("bad"), F.sum("score").alias("all")).filter("all > 0").select("host", (F.col("bad") / F.col("all")).alias("distrust"))
    share = scratch.table(share, "distrust")
    rows = keyed_join(judged, share, "host", "left")
    method = F.when(F.coalesce("distrust", F.lit(0.0)) > threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("listed", method).alias("verdict"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
