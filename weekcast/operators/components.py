"""Connected components of an edge table by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014). Each star is a map-side-combined
minimum per node, written once, and a salted join, so a node with very many neighbours is spread over tasks.
Rounds go on until nothing changes; their number grows with the log of the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from weekcast.operators.scale import spread_join
from weekcast.session import stage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u"), F.col("v")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(edges: DataFrame) -> DataFrame:
    """(u, m, _n): least neighbour and number of neighbours, written, for a star reads it several times."""
    return stage(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")), "least")


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node around it."""
    around = _both_ways(edges)
    least = _least(around)
    moved = spread_join(around.filter("v > u"), least.select("u", F.least("u", "m").alias("m")), ["u"], "inner", least, 2 * rows)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = _least(down)
    moved = spread_join(down, least.select("u", "m"), ["u"], "inner", least, rows)
    own = least.select("u", F.col("m").alias("v"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).filter("u <> v").distinct()


def _stage(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Written edges, and their count and hash sum taken while writing."""
    seen = Observation()
    watched = edges.observe(
        seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    )
    staged = stage(watched, "components")
    return staged, (seen.get["n"], seen.get["h"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v); component is the least node."""
    given = stage(edges.select("u", "v").distinct(), "edges")
    links, now = _stage(given.filter("u <> v"))
    before = None
    while now[0] and now != before:
        before = now
        large, (rows, _) = _stage(_large_star(links, now[0]))
        links, now = _stage(_small_star(large, rows))
    # Every edge now leads from a node to the least node of its component.
    nodes = _both_ways(given).select("u").distinct()
    return nodes.join(links, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))
