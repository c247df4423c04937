"""URL verdicts from host and path rules, and for the rest from trust and distrust spread over the host graph.

A host is a seed when rules give more than half of its pages one verdict. Trust starts at the allowed seeds and follows
the links; distrust starts at the blocked seeds and goes against them (who links to a blocked host is suspect). Both
are personalised PageRanks over distinct host edges: each step passes on 85 % of a host's new mass, in equal parts.
Masses are integers, so sums don't depend on their order and a repeated task gives the same verdict; parts are rounded
down, so new mass ends by itself, on cycles too, and steps go on until there is none. A host is blocked when its distrust reaches a share of one seed's mass and exceeds its
trust.

Host edges are pre-aggregated (distinct) before they are joined, and the hosts' verdicts are joined to the pages by
host, where adaptive execution splits a hot host; nothing but the number of hosts bounds the graph.

Defined results: a null url or one without `://` has an empty host and path, no rule and the verdict allow (it is no
host of the graph); null or empty html has no links; repeated pages give repeated results and count as pages of their
host; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritempo.llm.common import checkpoint

#: Mass of one seed.
SEED = 1_000_000_000
#: Per cent of new mass that a host passes on.
DAMPING = 85
#: Parts of a thousand of a seed's mass from which distrust counts.
THRESHOLD = 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        name, _, rest = rule.partition("/")
        hit = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        fits = F.when(hit, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of links with a host of their own in the pages' html."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""), 1)
    pairs = pages.select("host", F.explode(F.array_distinct(links)).alias("link"))
    edges = pairs.select(F.col("host").alias("src"), F.translate("link", _UPPER, _LOWER).alias("dst"))
    return edges.where("src != '' and src != dst").distinct()


def spread_mass(seeds: DataFrame, edges: DataFrame, steps: int | None = None) -> DataFrame:
    """Total trust and distrust of each reached host, from seeds(kind, host) with kinds trust and distrust.

    All steps are done; a number of steps ends the spread early, for tests.
    """
    flows = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"))
    flows = flows.unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to")))
    flows = flows.join(flows.groupBy("kind", "host").agg(F.count("*").alias("ways")), ["kind", "host"])
    flows = checkpoint(flows)
    new = checkpoint(seeds.select("kind", "host", F.lit(SEED).cast("long").alias("mass")))
    total = new
    for _ in count() if steps is None else range(steps):
        moved = new.join(flows, ["kind", "host"]).select("kind", F.col("to").alias("host"), F.expr(f"mass * {DAMPING} div (100 * ways)").alias("mass"))
        new = checkpoint(moved.groupBy("kind", "host").agg(F.sum("mass").alias("mass")).where("mass > 0"))
        if new.isEmpty():
            break
        total = checkpoint(total.unionByName(new).groupBy("kind", "host").agg(F.sum("mass").alias("mass")))
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0)).alias(kind) for kind in ("trust", "distrust")]
    return total.groupBy("host").agg(*sums)


def judge(pages: DataFrame, rules: list[tuple[str, str]], steps: int | None = None) -> DataFrame:
    """Columns page_id, host, path, rule and verdict of every page."""
    read = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    read = read.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    counts = [F.count_if(F.col("fit.verdict") == v).alias(v) for v in ("allow", "block")]
    hosts = read.where("host != ''").groupBy("host").agg(F.count("*").alias("n"), *counts)
    kind = F.when(F.col("allow") * 2 > F.col("n"), "trust").when(F.col("block") * 2 > F.col("n"), "distrust")
    scores = spread_mass(hosts.select(kind.alias("kind"), "host").where("kind is not null"), host_edges(read), steps)
    suspect = scores.where(F.col("distrust") * 1000 >= F.lit(SEED * THRESHOLD)).where("distrust > trust")
    rows = read.drop("html").join(suspect.select("host", F.lit(True).alias("suspect")), "host", "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("suspect"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
