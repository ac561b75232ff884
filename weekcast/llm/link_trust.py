"""URL verdicts from host rules and, where no rule fits, from the link graph.

Two personalised PageRanks run over host edges: trust starts at hosts with allowed pages and follows links;
distrust starts at hosts with blocked pages and runs against them, to those that link there (Gyöngyi et al.,
"TrustRank", 2004; Krishnan and Raj, "Anti-Trust Rank", 2006). A host is blocked if its distrust exceeds its
trust. Only column functions and joins are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from weekcast.session import stage

#: (verdict, rule) with the rule's host before the first slash and its path from there on.
Rules = Sequence[tuple[str, str]]

DAMPING = 0.85
TOLERANCE = 1e-3
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: Rules) -> DataFrame:
    """``pages`` (with host and path) with the longest fitting ``rule`` and its ``verdict``; both null if none fits."""
    rule, verdict = [], []
    for said, text in sorted(rules, key=lambda r: -len(r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + path))
        rule.append(F.when(fits, F.lit(text)))
        verdict.append(F.when(fits, F.lit(said)))
    return pages.select("*", F.coalesce(*rule).alias("rule"), F.coalesce(*verdict).alias("verdict"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, links) between different hosts, from the ``href`` of links in ``html``.

    Links without ``//`` stay on their own host and say nothing about others. Counted before the shuffle, so
    a host with very many pages costs a row per task and target.
    """
    link = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)).alias("link")
    links = pages.filter("host <> ''").select(F.col("host").alias("source"), link).filter(F.col("link").contains("//"))
    target = host_of(F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link")))
    return links.select("source", target.alias("target")).filter("target <> '' and source <> target").groupBy("source", "target").agg(F.count("*").alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) for every host of ``seeds`` (host, allowed, blocked: pages of each kind) and ``edges``.

    Each rank sums to 1 unless it has no seed; then it is 0. What a host without links to pass on holds goes
    back to the seeds. Rounds go on until no host is reached for the first time and each host's ranks change by less
    than ``tolerance`` of themselves, however small its share of the sum; the damping brings that about. Each round
    is written to the shared folder.
    """
    edges = stage(edges, "host-edges")
    out = edges.groupBy("source").agg(F.sum("links").alias("_out"))
    into = edges.groupBy("target").agg(F.sum("links").alias("_in"))
    weighted = stage(
        edges.join(out, "source").join(into, "target").select("source", "target", (F.col("links") / F.col("_out")).alias("forth"), (F.col("links") / F.col("_in")).alias("back")),
        "host-weights",
    )
    # Hosts that have seeds, links or both; one row each.
    known = (
        seeds.select("host", "allowed", "blocked", F.lit(0).alias("_from"), F.lit(0).alias("_to"))
        .unionByName(edges.select(F.col("source").alias("host"), F.lit(0).alias("allowed"), F.lit(0).alias("blocked"), F.lit(1).alias("_from"), F.lit(0).alias("_to")))
        .unionByName(edges.select(F.col("target").alias("host"), F.lit(0).alias("allowed"), F.lit(0).alias("blocked"), F.lit(0).alias("_from"), F.lit(1).alias("_to")))
        .groupBy("host")
        .agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"), F.max("_from").alias("_from"), F.max("_to").alias("_to"))
    )
    totals = known.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    share = lambda c, n: F.col(c) / F.lit(float(n or 1))
    seeded = stage(known.select("host", share("allowed", totals["a"]).alias("_t0"), share("blocked", totals["b"]).alias("_d0"), "_from", "_to"), "host-seeds")

    def moved_by(now: str, before: str) -> Column:
        """Change as a share of the rank; 1 where a host is reached for the first time."""
        return F.when(F.col(now) != F.col(before), F.abs(F.col(now) - F.col(before)) / F.greatest(now, before)).otherwise(0.0)

    def kept(ranks: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        watched = ranks.observe(
            seen,
            F.coalesce(F.sum(F.when(F.col("_from") == 0, F.col("trust"))), F.lit(0.0)).alias("loose_trust"),
            F.coalesce(F.sum(F.when(F.col("_to") == 0, F.col("distrust"))), F.lit(0.0)).alias("loose_distrust"),
            F.coalesce(F.max(F.greatest(moved_by("trust", "_trust"), moved_by("distrust", "_distrust"))), F.lit(0.0)).alias("change"),
        )
        return stage(watched, "host-ranks"), seen.get

    state, seen = kept(seeded.select("*", F.col("_t0").alias("trust"), F.col("_d0").alias("distrust"), F.lit(0.0).alias("_trust"), F.lit(0.0).alias("_distrust")))
    if weighted.isEmpty():
        return state.select("host", "trust", "distrust")
    while seen["change"] >= tolerance:
        ranks = state.select("host", "trust", "distrust")
        forth = weighted.join(ranks, weighted.source == ranks.host).select(F.col("target").alias("host"), (F.col("trust") * F.col("forth")).alias("t"), F.lit(0.0).alias("d"))
        back = weighted.join(ranks, weighted.target == ranks.host).select(F.col("source").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("back")).alias("d"))
        gained = forth.unionByName(back).groupBy("host").agg(F.sum("t").alias("_gt"), F.sum("d").alias("_gd"))
        new = lambda start, gain, loose: F.lit(1 - damping) * F.col(start) + F.lit(damping) * (F.coalesce(F.col(gain), F.lit(0.0)) + F.lit(loose) * F.col(start))
        moved = state.drop("_trust", "_distrust").withColumnsRenamed({"trust": "_trust", "distrust": "_distrust"}).join(gained, "host", "left")
        state, seen = kept(
            moved.select(
                "host", "_t0", "_d0", "_from", "_to", new("_t0", "_gt", seen["loose_trust"]).alias("trust"), new("_d0", "_gd", seen["loose_distrust"]).alias("distrust"), "_trust", "_distrust"
            )
        )
    return state.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: Rules) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of ``pages`` (page_id, url, html).

    The longest fitting rule decides; otherwise the host's ranks do, and a host that neither rank reaches is
    allowed. A url that is null or has no ``://`` has an empty host, which is such a host. Repeated rows stay,
    null html has no links, other columns are not read, and an empty table gives an empty result.
    """
    placed = ruled(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    seeds = placed.filter("host <> '' and rule is not null").groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    edges = host_edges(pages.select(host_of(F.col("url")).alias("host"), "html"))
    # The host table is joined plainly: broadcast only if Spark finds it small, and split at hot hosts if not.
    ranks = propagate(seeds, edges).select(F.col("host").alias("_host"), "trust", "distrust")
    joined = placed.join(ranks, F.when(F.col("host") != "", F.col("host")) == F.col("_host"), "left").fillna(0.0, ["trust", "distrust"])
    by_graph = F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_graph).alias("verdict"), "trust", "distrust")
