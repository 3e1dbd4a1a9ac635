"""URL filters: rules by host and path, and a link graph for what no rule judges.

Rules ``(verdict, host, path)`` fit their host and its subdomains where the url's path starts with the rule's; the longest rule (its host and path,
in code points; of equal ones the longer host, then ``block``) decides. What no rule fits is judged by its host. Hosts are nodes, links of
pages to other hosts are edges, weighted by the number of links. A host some of whose pages rules allow is a trusted seed, one some
of whose pages they block a blocked seed, each with the share of its pages as weight. Personalised PageRank hands trust from trusted seeds along
the links; distrust starts at blocked seeds and runs against them, to those that link there. Both are scaled by their seeds' total weight, so
that a host without links keeps its own share. A host is blocked if its distrust is at least ``least`` and more than ``ratio`` times its trust.

Each round is one join and one sum with map-side combine over (kind, host); both directions take part in it as kinds. A host that links to very many others has its
edges dealt over shares of ``share_edges``, so no task holds all of them. Ranks go from round to round through tables in the shared folder.
Two numbers a direction reach the driver: the mass of hosts without onward links, which starts at the seeds again, and the change.

The rules are an expression of the query, meant for lists of up to some hundreds.

Defined results: a null url, or one without ``://``, has an empty host and path; no rule fits it, no link starts there, and it is allowed. Null html has no
link. Rows that repeat count each, null page ids included; an empty table gives an empty result; other columns stay out of the
result. Texts of any length are read whole, on the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import Store

LINK = r"""(?i)<a\s[^<>]*?\bhref\s*=\s*["']?([^"'\s<>]+)"""
TARGET = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
ALLOW, BLOCK = "allow", "block"
TRUST, DISTRUST = 0, 1


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlParams:
    damping: float = 0.85
    rounds: int = 60
    tolerance: float = 1e-4  # change of all ranks of a direction, whose sum is 1
    least: float = 0.02
    ratio: float = 1.0
    share_edges: int = 10_000


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    inside = (host == rule.host) | host.endswith("." + rule.host)
    return inside & path.startswith(rule.path)


def judge(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.verdict == BLOCK)):
        fit = fits(rule, host, path)
        text, verdict = F.when(fit, rule.text).otherwise(text), F.when(fit, rule.verdict).otherwise(verdict)
    return text, verdict


def page_table(pages: DataFrame, rules: Sequence[Rule], page: str = "page_id", url: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` by rules alone."""
    parts = pages.select(F.col(page).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    text, verdict = judge(F.col("host"), F.col("path"), rules)
    return parts.select("page_id", "host", "path", text.alias("rule"), verdict.alias("verdict"))


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst, links)``: links from pages of one host to another."""
    links = pages.select(host_of(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).alias("link"))
    hosts = links.select("src", ascii_lower(F.regexp_extract("link", TARGET, 1)).alias("dst"))
    return hosts.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def seeds_of(judged: DataFrame) -> DataFrame:
    """``(host, trusted, blocked)``: the shares of each host's pages that rules allow and block."""
    share = lambda verdict: (F.count(F.when(F.col("verdict") == verdict, 1)) / F.count("*"))
    return judged.where("host <> ''").groupBy("host").agg(share(ALLOW).alias("trusted"), share(BLOCK).alias("blocked"))


def propagate(edges: DataFrame, seeds: DataFrame, store: Store, params: UrlParams = UrlParams()) -> DataFrame:
    """``(host, trust, distrust)`` of every host of ``edges(src, dst, links)`` and ``seeds(host, trusted, blocked)``."""
    spark = seeds.sparkSession
    ways = edges.select(F.lit(TRUST).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "links").unionByName(
        edges.select(F.lit(DISTRUST).alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "links"))
    out = store.put(ways.groupBy("kind", "host").agg(F.sum("links").alias("total"), (F.floor(F.count("*") / params.share_edges) + 1).cast("int").alias("shares")))
    flow = store.put(ways.join(out, ["kind", "host"]).select(
        "kind", "host", F.pmod(F.xxhash64("to"), F.col("shares")).cast("int").alias("share"), "to", (F.col("links") / F.col("total")).alias("weight")))

    weights = seeds.agg(F.sum("trusted").alias("trusted"), F.sum("blocked").alias("blocked")).first()
    total = {TRUST: weights["trusted"] or 0.0, DISTRUST: weights["blocked"] or 0.0}
    scale = F.when(F.col("kind") == TRUST, F.lit(total[TRUST])).otherwise(F.lit(total[DISTRUST]))
    own = seeds.select("host", F.explode(F.array(
        F.struct(F.lit(TRUST).alias("kind"), F.col("trusted").alias("seed")), F.struct(F.lit(DISTRUST).alias("kind"), F.col("blocked").alias("seed")))).alias("s")).select("host", "s.*")
    nodes = own.unionByName(ways.select(F.col("to").alias("host"), "kind", F.lit(0.0).alias("seed"))).unionByName(ways.select("host", "kind", F.lit(0.0).alias("seed")))
    first = nodes.groupBy("kind", "host").agg(F.sum("seed").alias("seed")).join(out.select("kind", "host", "shares"), ["kind", "host"], "left")
    first = first.withColumn("seed", F.when(scale > 0, F.col("seed") / scale).otherwise(0.0))
    ranks = store.put(first.select("kind", "host", "seed", F.coalesce("shares", F.lit(0)).alias("shares"), F.col("seed").alias("rank")))

    for _ in range(params.rounds):
        lost = {r["kind"]: r["lost"] for r in ranks.where("shares = 0").groupBy("kind").agg(F.sum("rank").alias("lost")).collect()}
        again = F.when(F.col("kind") == TRUST, F.lit(lost.get(TRUST, 0.0))).otherwise(F.lit(lost.get(DISTRUST, 0.0)))
        sent = ranks.where("shares > 0 and rank > 0").select("kind", "host", "rank", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        come = sent.join(flow, ["kind", "host", "share"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("rank") * F.col("weight")).alias("come"))
        rank = F.col("seed") * (1 - params.damping + params.damping * again) + params.damping * F.coalesce("come", F.lit(0.0))
        after = store.put(ranks.select("kind", "host", "seed", "shares", F.col("rank").alias("before")).join(come, ["kind", "host"], "left").select("kind", "host", "seed", "shares", rank.alias("rank"), "before"))
        moved = max((r["moved"] for r in after.groupBy("kind").agg(F.sum(F.abs(F.col("rank") - F.col("before"))).alias("moved")).collect()), default=0.0)
        store.drop(ranks)
        ranks = after
        if moved <= params.tolerance:
            break
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)) * F.lit(total[kind])
    return ranks.groupBy("host").agg(of(TRUST).alias("trust"), of(DISTRUST).alias("distrust"))


def distrusted(trust: Column, distrust: Column, params: UrlParams = UrlParams()) -> Column:
    return (distrust >= params.least) & (distrust > params.ratio * trust)


def filter_urls(pages: DataFrame, rules: Sequence[Rule], store: Store, page: str = "page_id", url: str = "url", html: str = "html", params: UrlParams = UrlParams()) -> DataFrame:
    """One row a page: ``page_id, host, path, rule, verdict``, and its host's ``trust`` and ``distrust``."""
    judged = store.put(page_table(pages, rules, page, url))
    edges = store.put(host_edges(pages, url, html))
    hosts = store.put(propagate(edges, seeds_of(judged), store, params))
    found = judged.join(hosts, "host", "left")
    known = lambda c: F.coalesce(c, F.lit(0.0))
    own = F.when(distrusted(known("trust"), known("distrust"), params), BLOCK).otherwise(ALLOW)
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), known("trust").alias("trust"), known("distrust").alias("distrust"))
