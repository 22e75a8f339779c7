"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keymoment.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for each node of edges(a, b): nodes with the same root are connected.

    Each round sends every node to its smallest neighbour, if that is smaller, and replaces the ends of all edges so;
    edges within a node go. Node ids that are hashes make the number of rounds logarithmic, whatever the shape.
    A round is three joins and an aggregate with partial sums, whose inputs are tables in the shared folder: no node's
    edges are gathered in a task, nothing goes to the driver but whether edges are left. An empty table has no nodes.
    """
    links = scratch.keep(edges.select("a", "b").where("a <> b").distinct(), f"{name}-links-0")
    root = None
    for turn in range(1, 200):
        if links.isEmpty():
            break
        both = links.select("a", "b").union(links.select("b", "a"))
        step = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        step = scratch.keep(step, f"{name}-step-{turn}")
        if root is None:
            root = step.select("node", F.col("to").alias("root"))
        else:
            moved = step.where("node <> to").select(F.col("node").alias("root"), "to")
            root = root.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        root = scratch.keep(root, f"{name}-root-{turn}")
        one = links.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").select("x", "b")
        one = one.join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        links = scratch.keep(one.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links-{turn}")
    if root is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return root
