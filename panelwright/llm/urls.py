"""URL filter: rules, then trust and distrust over the host graph, in DataFrame functions only.

A rule decides the urls it fits, the longest first. Hosts of which rules allow most pages are trusted seeds,
hosts of which rules block most pages are blocked seeds. Personalised PageRank carries trust from the trusted
seeds along links, and distrust from the blocked seeds against them: who links to a blocked host is
suspect. A url that no rule fits is blocked if its host has more distrust than trust by ``MARGIN`` times.

Ranks live on hosts and on distinct host edges with their weights, so a host with a third of all pages is one
node and its links combine on the map side. Each round is written, which cuts the lineage.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and is allowed; a null
html has no links; null and repeated ids are carried along; without seeds or links nothing is propagated; an
empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import query, table
from panelwright.session import materialize

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING = 0.85
TOLERANCE = 1e-9  # rounds end when the masses change by no more in all
SEED_SHARE = 0.5  # of a host's pages, what rules must settle for the host to be a seed
MARGIN = 1.0
_LINK = r"(?i)(?:href|src)\s*=\s*[\"']?([^\"'\s>]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def edges(pages: DataFrame) -> DataFrame:
    """``(a, b, links)``: host edges of ``(host, html)``, links to the own host left out."""
    target = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)))
    out = pages.where("host <> ''").select(F.col("host").alias("a"), target.alias("link"))
    b = host_of(F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")))
    return out.withColumn("b", b).where("b <> '' AND a <> b").groupBy("a", "b").agg(F.count("*").alias("links"))


def propagate(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(kind, host, mass)`` from ``(kind, host, mass)`` seeds whose masses sum to one for each kind.

    Kind ``trust`` follows links, kind ``distrust`` goes against them; mass without a way on returns to the seeds.
    """
    flows = links.select(F.lit("trust").alias("kind"), F.col("a").alias("host"), F.col("b").alias("to"), "links").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("b").alias("host"), F.col("a").alias("to"), "links"))
    total = flows.groupBy("kind", "host").agg(F.sum("links").alias("all"))
    flows = materialize(flows.join(total, ["kind", "host"]).select("kind", "host", "to", (F.col("links") / F.col("all")).alias("share")), "flows")
    state = seeds
    if flows.limit(1).count() == 0:
        return state
    while True:  # the error falls by the damping factor a round, so this ends
        moved = state.join(flows, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(
            F.sum(F.col("mass") * F.col("share") * DAMPING).alias("mass"))
        kept = moved.groupBy("kind").agg(F.sum("mass").alias("flowed"))  # two rows
        back = seeds.join(kept, "kind", "left").select("kind", "host", (F.col("mass") * (1 - F.coalesce("flowed", F.lit(0.0)))).alias("mass"))
        new = materialize(moved.unionByName(back).groupBy("kind", "host").agg(F.sum("mass").alias("mass")), "mass")
        both = new.select("kind", "host", F.col("mass").alias("x")).unionByName(state.select("kind", "host", (-F.col("mass")).alias("x")))
        change = both.groupBy("kind", "host").agg(F.abs(F.sum("x")).alias("x")).agg(F.sum("x")).first()[0]
        state = new
        if change <= TOLERANCE:
            return state


def judge(pages: DataFrame, *, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` of ``(page_id, url, html)``."""
    named = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = named.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    act = F.lit(None).cast("string")
    for verdict, rule in rules:
        act = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(act)
    ruled = ruled.withColumn("act", act)
    hosts = materialize(ruled.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("act") == "allow").alias("allow"), F.count_if(F.col("act") == "block").alias("block")), "hosts")
    seeds = hosts.where(F.col("allow") > F.col("n") * SEED_SHARE).select(F.lit("trust").alias("kind"), "host").unionByName(
        hosts.where(F.col("block") > F.col("n") * SEED_SHARE).select(F.lit("distrust").alias("kind"), "host"))
    each = seeds.groupBy("kind").agg((1 / F.count("*")).alias("mass"))
    seeds = materialize(seeds.join(each, "kind").select("kind", "host", "mass"), "seeds")
    mass = propagate(edges(named.select("host", "html")), seeds)
    per = mass.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("mass"))).alias("trust"),
                                   F.sum(F.when(F.col("kind") == "distrust", F.col("mass"))).alias("distrust"))
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    return ruled.select("page_id", "host", "path", "rule", "act").join(per, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("act", F.when(distrust > trust * MARGIN, "block").otherwise("allow")).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"))


@query("op10_link_graph")
def op10_link_graph(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
