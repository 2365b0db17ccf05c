"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm import support


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of bigint ids to (node, component), the component being its smallest node.

    Every round, each node hooks on to the least of itself and its neighbours, and pointers are doubled until each points to
    its tree's root, its smallest node. Then the roots stand for their trees: edges within a tree are done with, and equal
    ones are merged, so a round works on what the rounds before it left. A root is less than all its neighbours, so each
    round leaves at most half of the nodes that had an edge. Each step is written to the shared folder, so lineage stays
    short and lost executors cost one step at most. Only one count a step reaches the driver.
    """
    left, placed = support.checkpoint(_plain(edges)), None
    while True:
        both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        trees = support.checkpoint(both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("label")))
        while True:
            further = trees.filter("node <> label").select(F.col("node").alias("label"), F.col("label").alias("further"))
            found = support.checkpoint(trees.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label"), F.col("further").isNotNull().alias("moved")))
            trees = found.select("node", "label")
            if not found.filter("moved").limit(1).count():
                break
        trees = trees.withColumnRenamed("label", "component")
        placed = trees if placed is None else support.checkpoint(_onward(placed, trees))
        left = support.checkpoint(_plain(_contracted(left, trees, "inner")))
        if not left.limit(1).count():
            return placed


def extended(known: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, component) of the graph that ``known`` are the components of, with ``edges`` added."""
    found = components(_contracted(_plain(edges), known, "left"))
    new = found.join(known.select("node"), "node", "left_anti")
    return support.checkpoint(_onward(known, found).union(new))


def _plain(edges: DataFrame) -> DataFrame:
    """Each edge once, whatever its direction, without loops."""
    return edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _contracted(edges: DataFrame, placed: DataFrame, how: str) -> DataFrame:
    """The edges between what ``placed`` (node, component) puts for their ends."""
    for end in ("u", "v"):
        edges = edges.join(placed.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, how)
    return edges.select(F.coalesce("of_u", "u").alias("u"), F.coalesce("of_v", "v").alias("v"))


def _onward(placed: DataFrame, further: DataFrame) -> DataFrame:
    """``placed`` with the component of its component, where ``further`` has one."""
    onward = further.select(F.col("node").alias("component"), F.col("component").alias("further"))
    return placed.join(onward, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
