"""Distributed union-find over a table of edges between 64-bit nodes.

Edges are united in as many tasks as they fill blocks of ``BLOCK``; each keeps one edge per node, to the least node
of its set. A single block is done by that. Otherwise the rest, dealt by node, which has one edge per task at most,
is united once more. Then a node with a single edge that leads
nowhere else is a leaf and is set aside. Only what is left, the core, goes through star rounds; most often it is empty
or small. The order of edges, their repeats and loops change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weekcast.operators.components import connected_components
from weekcast.operators.scale import spread_join
from weekcast.session import stage

#: Edges that a task unites at once, whatever their number in all; it bounds its memory.
BLOCK = 1 << 20


def least_of_sets(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its set) for all nodes of the edges, nodes ascending."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    parent = np.arange(len(nodes))
    while len(a):
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = parent[parent]
            if np.array_equal(further, parent):
                break
            parent = further
        a, b = parent[a], parent[b]
        unlike = a != b
        a, b = a[unlike], b[unlike]
    return nodes, nodes[parent]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def forest() -> pa.RecordBatch:
        nodes, least = least_of_sets(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
        child = nodes != least
        return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(least[child])], ["u", "v"])

    held, rows = [], 0
    for batch in batches:
        held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        rows += batch.num_rows
        if rows >= BLOCK:
            yield forest()
            held, rows = [], 0
    if held:
        yield forest()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes that an edge (u, v; long, not null) joins to another; component is the least node.

    ``edges`` is read twice, so it had best be a written table.
    """
    blocks = -(-edges.count() // BLOCK)
    united = edges.select("u", "v").coalesce(max(1, blocks)).mapInArrow(_united, "u long, v long")
    if blocks <= 1:
        trees = stage(united, "forest")
        heads = trees.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
        return trees.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
    forest = stage(united.repartition("u").mapInArrow(_united, "u long, v long"), "forest")
    ends = forest.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(forest.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    leaf = (F.sum("up") == 1) & (F.sum("down") == 0)
    kinds = ends.groupBy("node").agg(leaf.alias("_leaf"))
    told = stage(forest.join(kinds, forest["u"] == kinds["node"]).select("u", "v", "_leaf"), "leaves")
    core = told.filter(~F.col("_leaf")).select("u", "v")
    leaves = told.filter("_leaf").select("u", "v")
    if core.isEmpty():
        heads = leaves.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
        return leaves.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
    inner = stage(connected_components(core), "core")
    placed = spread_join(leaves, inner.withColumnRenamed("node", "v"), ["v"], "left")
    outer = placed.select(F.col("u").alias("node"), F.coalesce("component", "v").alias("component"))
    heads = leaves.select(F.col("v").alias("node")).distinct().join(inner, "node", "left_anti")
    return outer.unionByName(inner).unionByName(heads.select("node", F.col("node").alias("component")))
