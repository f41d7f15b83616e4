"""URL filters: rules over hosts and paths, and trust that spreads over the links between hosts."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger.sources.workspace import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEW_STEPS = 1_000_000  # links of hosts that one task may walk, of some hundred bytes each
_LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, for paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rules_of(spark, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.verdict, r.host, r.path, r.name) for r in rules], "verdict string, host string, path string, rule string")


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def host_of(url: Column) -> Column:
    """What stands after the first `://`, up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """A host and all domains above it."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def apply_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds `rule` and `ruled` (its verdict) to rows with `host` and `path`: the longest rule that fits, else null.

    Rules meet distinct hosts, not pages, so a rule of a top-level domain is joined once per host below it. A
    host's rules are one value: as many as are written for it and the domains above it.
    """
    hosts = pages.where("host <> ''").select("host").distinct()
    named = rules.select(F.col("host").alias("domain"), F.col("path").alias("prefix"), "rule", F.col("verdict").alias("ruled"))
    met = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("domain")).join(named, "domain")
    each = F.struct(F.length("rule").alias("n"), "rule", "ruled", "prefix")
    lists = met.groupBy("host").agg(F.collect_set(each).alias("__rules"))
    fits = F.array_max(F.filter("__rules", lambda r: F.startswith(F.col("path"), r["prefix"])))
    out = pages.join(lists, "host", "left").withColumn("__best", fits)
    return out.withColumn("rule", F.col("__best.rule")).withColumn("ruled", F.col("__best.ruled")).drop("__rules", "__best")


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts: `src`, `dst`, `links`. `pages` has `host` and `html`.

    Links of a page to one host are counted once. Besides, a known host and the nearest known domain above it are
    linked both ways: whoever owns the one owns the other. Links without a host stay within their own host.
    """
    targets = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER)))
    told = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(targets).alias("dst")).where("src <> dst")
    told = cut(told.groupBy("src", "dst").agg(F.count("*").cast("double").alias("links")), "host-links")
    known = pages.where("host <> ''").select("host").union(told.select("dst")).distinct()
    above = known.select("host", F.posexplode(suffixes(F.col("host"))).alias("up", "domain")).where("up > 0")
    kin = above.join(known.select(F.col("host").alias("domain")), "domain").groupBy("host").agg(F.min_by("domain", "up").alias("domain"))
    one = F.lit(1.0)
    both = kin.select(F.col("host").alias("src"), F.col("domain").alias("dst"), one.alias("links"))
    back = kin.select(F.col("domain").alias("src"), F.col("host").alias("dst"), one.alias("links"))
    return told.unionByName(both).unionByName(back).groupBy("src", "dst").agg(F.sum("links").alias("links"))


def rounds_for(damping: float, tolerance: float) -> int:
    """Rounds after which no start can be further from the end than the tolerance, as a share of the mass: each round leaves at
    most the damped part of the distance."""
    return math.ceil(math.log(tolerance) / math.log(damping))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-6, rounds: int | None = None, every: int = 10, few: int = FEW_STEPS) -> DataFrame:
    """Trust along the links and distrust against them: `host`, `trust`, `distrust`, each summing up to 1.

    `seeds` has `host`, `good` and `bad`, the weights of trusted and blocked seeds. Each is a personalised
    PageRank: of what a host has, the damped part goes on over its links in proportion to their number, and
    the rest starts again at the seeds. What hosts without links hold starts again there too, which is the same
    as leaving it out and scaling the sums to 1 in the end. Of seeds without weight, all scores are 0.

    It runs until the scores are within the tolerance: as many rounds as the damping asks for, whatever the graph, or
    `rounds` if given. The state is written every few of them, so lineage stays short. What a host takes in is partly
    added up before the shuffle. Links are counted first: up to `few`, a round is not worth a shuffle, and the rounds between two
    writes run in one task, with the same joins and sums.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("n"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("n"))
    forth = edges.join(out, "src").select(F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("links") / F.col("n")).alias("f"), F.lit(0.0).alias("b"))
    back = edges.join(into, "dst").select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(0.0).alias("f"), (F.col("links") / F.col("n")).alias("b"))
    steps = forth.unionByName(back).groupBy("at", "to").agg(F.sum("f").alias("f"), F.sum("b").alias("b"))
    steps = cut(steps, "host-steps")
    small = steps.count() <= few
    placed = (lambda rows: rows.coalesce(1)) if small else (lambda rows: rows)
    met = (lambda rows: rows.hint("shuffle_hash")) if small else (lambda rows: rows)
    steps = placed(steps)
    good, bad = seeds.agg(F.sum("good"), F.sum("bad")).first() or (None, None)
    share = lambda c, total: F.col(c) / F.lit(float(total)) if total else F.lit(0.0)
    start = cut(seeds.select("host", share("good", good).alias("g"), share("bad", bad).alias("w")), "host-seeds")
    state = start.select("host", F.col("g").alias("trust"), F.col("w").alias("distrust"))
    rounds = rounds_for(damping, tolerance) if rounds is None else rounds
    for i in range(rounds):
        sent = steps.join(met(placed(state)), F.col("at") == F.col("host")).select(
            F.col("to").alias("host"), (damping * F.col("f") * F.col("trust")).alias("trust"), (damping * F.col("b") * F.col("distrust")).alias("distrust")
        )
        fresh = start.select("host", ((1 - damping) * F.col("g")).alias("trust"), ((1 - damping) * F.col("w")).alias("distrust"))
        state = placed(sent.unionByName(fresh)).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if (i + 1) % every == 0 or i + 1 == rounds:
            state = cut(state, "host-trust")
    t, d = state.agg(F.sum("trust"), F.sum("distrust")).first()
    scaled = lambda c, total: F.col(c) / F.lit(float(total)) if total else F.lit(0.0)
    return state.select("host", scaled("trust", t).alias("trust"), scaled("distrust", d).alias("distrust"))


def judge(
    pages: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    *,
    seed_share: float = 0.5,
    threshold: float = 1.0,
    damping: float = 0.85,
    tolerance: float = 1e-6,
) -> DataFrame:
    """Per page row: key, `host`, `path`, `rule`, `verdict`, `trust`, `distrust`.

    A page with a rule gets the longest fitting rule's verdict. Any other page is blocked if its host's distrust
    exceeds its trust, and is at least `threshold` times the mean over hosts with any score; else it is allowed. Seeds are hosts that
    rules decide for at least `seed_share` of their pages: trusted by allowed pages, blocked by blocked ones,
    weighted by that share; trust and distrust are right to `tolerance` of their sums. Urls that are null or without `://` have an empty host, no rule and are allowed;
    null html has no links; repeated rows are judged alike; an empty table gives no rows. Only the named
    columns are read.
    """
    read = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    ruled = cut(apply_rules(read.select("key", "host", "path"), rules), "ruled-pages")
    part = lambda verdict: F.avg(F.when(F.col("ruled") == verdict, 1.0).otherwise(0.0))
    hosts = ruled.where("host <> ''").groupBy("host").agg(part("allow").alias("good"), part("block").alias("bad"))
    strong = lambda c: F.when(F.col(c) >= seed_share, F.col(c)).otherwise(0.0)
    seeds = hosts.select("host", strong("good").alias("good"), strong("bad").alias("bad"))
    scores = propagate(host_edges(read), seeds, damping=damping, tolerance=tolerance)
    mean = scores.agg(F.avg("distrust")).first()[0] or 0.0
    blocked = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= threshold * mean)
    out = ruled.join(scores, "host", "left")
    verdict = F.coalesce("ruled", F.when(blocked, "block").otherwise("allow"))
    zero = F.lit(0.0)
    return out.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))
