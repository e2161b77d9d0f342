"""URL verdicts: fixed rules first, then trust and distrust spread over the graph of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import without
from quillmill.operators.scale import salted_join
from quillmill.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values of the registered query: (action, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UNIT = 1_000_000_000  # the score that a seed receives
ADDED = ["host", "path", "rule", "verdict", "trust", "distrust"]


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; NULL without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct<action, rule>; NULL if none does.

    A rule fits its host and all subdomains if the path starts with its path. Of rules of equal
    length at most one fits, unless the same rule is listed twice: then the first counts.
    """
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    chosen = None
    for action, rule_host, rule_path in ordered:
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(
            path, F.lit(rule_path)
        )
        value = F.struct(F.lit(action).alias("action"), F.lit(rule_host + rule_path).alias("rule"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return F.lit(None).cast("struct<action:string,rule:string>") if chosen is None else chosen


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts. Relative links stay on their host.

    Counted per pair of hosts before the shuffle, so a host with a third of all pages costs one
    row per task and target.
    """
    target = F.explode(F.regexp_extract_all(
        F.col("html"), F.lit(r"""(?i)\bhref\s*=\s*["']?([^"'\s>]++)"""), F.lit(1)
    ))
    links = pages.where(F.col("html").contains("://") | F.col("html").contains("//")).select(
        host_of(F.col("url")).alias("src"), target.alias("link")
    )
    full = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), F.col("link"))).otherwise(
        F.col("link")
    )
    # A query string may hold a second address: only a scheme at the very start counts.
    absolute = F.when(full.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*+://"), full)
    return (
        links.select("src", host_of(absolute).alias("dst"))
        .where("src <> '' AND dst <> '' AND src <> dst")
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    )


def propagate(
    edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: int = UNIT // 10_000
) -> DataFrame:
    """(host, trust, distrust) by two personalised PageRanks at once.

    ``seeds`` has (host, kind, weight) with kind trust or distrust and a weight of 0 to 1, one
    row per pair. Trust flows from a host to the hosts it links to, in proportion to the links;
    distrust flows backwards, from a host to those that link to it. A seed receives ``UNIT`` *
    (1 - damping) * weight per round. Scores are whole numbers rounded down edge by edge, so
    sums do not depend on the order of rows. What reaches a host without a further edge
    stays there.

    Scores only grow. What all of them may still gain is at most the growth of the last
    round times damping / (1 - damping); rounds go on until that is no more than
    ``tolerance``, so no score is further from its limit than that.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("total"))
    flows = materialize(
        salted_join(edges, out, ["src"], ["dst"]).select(
            F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"),
            (F.col("n") / F.col("total")).alias("share"),
        ).unionByName(salted_join(edges, into, ["dst"], ["src"]).select(
            F.lit("distrust").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"),
            (F.col("n") / F.col("total")).alias("share"),
        )),
        "link-flows",
    )
    given = materialize(
        seeds.select("kind", F.col("host").alias("node"),
                     F.floor(F.col("weight") * round(UNIT * (1 - damping))).cast("bigint")
                     .alias("score")).where("score > 0"),
        "link-seeds",
    )
    state, mass = given, given.agg(F.sum("score")).first()[0] or 0
    while mass and not flows.isEmpty():
        # A host with many links is spread over salts; each pair sums before the shuffle.
        moved = salted_join(
            flows, state.select("kind", F.col("node").alias("from"), "score"), ["kind", "from"], ["to"]
        ).select("kind", F.col("to").alias("node"),
                 F.floor(F.col("score") * F.col("share") * damping).cast("bigint").alias("score"))
        state = materialize(
            given.unionByName(moved).groupBy("kind", "node").agg(F.sum("score").alias("score"))
            .where("score > 0"),
            "link-scores",
        )
        before, mass = mass, state.agg(F.sum("score")).first()[0]
        if (mass - before) * damping / (1 - damping) <= tolerance:
            break
    return state.groupBy(F.col("node").alias("host")).agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0)).alias("distrust"),
    )


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] | None = None,
    damping: float = 0.85,
    tolerance: int = UNIT // 10_000,
    min_distrust: int = UNIT // 100,
) -> DataFrame:
    """Judge every url of ``pages`` (url, html, ...): by the longest rule, else by its host.

    A host is a seed of trust by the share of its pages that a rule allows, and one of distrust
    by the share that a rule blocks. Scores spread over the links between hosts, see
    ``propagate``. A page without a rule is blocked if its host's distrust is at least
    ``min_distrust`` and exceeds its trust, else allowed; a host without any score is allowed.
    What a host has as a seed counts in its own verdict only if it comes from more than half
    of its pages: a host with a few blocked pages is not blocked by them, but hosts that link
    to it are judged by them.

    Adds host, path, rule (host and path of the rule, else NULL), verdict, trust and distrust.
    A NULL url, or one without ``://``, has an empty host and path, fits no rule and is
    allowed. NULL html has no links. All rows and columns are kept, repeated rows too; a column
    that clashes with an added one is replaced.
    """
    clean = without(pages, ADDED)
    parts = clean.withColumns({
        "__host": host_of(F.col("url")), "__path": path_of(F.col("url")),
    }).withColumn(
        "__rule", matching_rule(F.col("__host"), F.col("__path"), RULES if rules is None else rules)
    )
    counts = (
        parts.where("__host <> ''").groupBy(F.col("__host").alias("host"))
        .agg(F.count(F.lit(1)).alias("n"),
             F.count_if(F.col("__rule.action") == "allow").alias("allowed"),
             F.count_if(F.col("__rule.action") == "block").alias("blocked"))
    )
    share = {"trust": F.col("allowed") / F.col("n"), "distrust": F.col("blocked") / F.col("n")}
    seeds = counts.select("host", F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), weight.alias("weight")) for kind, weight in share.items()
    ])).alias("x")).select("host", "x.*").where("weight > 0")
    scores = propagate(materialize(host_edges(pages), "link-edges"), seeds, damping, tolerance)
    minor = {
        kind: F.when(F.coalesce(weight, F.lit(0.0)) <= 0.5, F.floor(
            F.coalesce(weight, F.lit(0.0)) * round(UNIT * (1 - damping))).cast("bigint")).otherwise(0)
        for kind, weight in share.items()
    }
    judged = {kind: F.col(kind) - own for kind, own in minor.items()}
    scores = materialize(
        scores.join(counts, "host", "left").select(
            F.col("host").alias("__h"), "trust", "distrust",
            ((judged["distrust"] >= min_distrust) & (judged["distrust"] > judged["trust"])).alias("bad")),
        "host-scores",
    )
    bad = F.coalesce("bad", F.lit(False))
    return parts.join(scores, F.col("__host") == F.col("__h"), "left").select(
        *clean.columns, F.col("__host").alias("host"), F.col("__path").alias("path"),
        F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.action"), F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0)).cast("bigint").alias("trust"),
        F.coalesce("distrust", F.lit(0)).cast("bigint").alias("distrust"),
    )
