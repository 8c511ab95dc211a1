"""Connected components of a graph whose edges are a table.

Each round hangs every node's smaller neighbours and the node itself on the smallest of them,
until each node has one smaller neighbour at most. What is left is a forest; its nodes then
jump to their parent's parent until they reach the root. Rows are grouped by the larger end
only, so a hub, the smallest node of a large star, never gathers its neighbours in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idcordon.sources.shared import stored


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); component: the smallest node reachable.

    Loops and repeated edges don't matter; edges with a null end are left out. No edges: no rows.
    """
    links = stored(
        edges.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
        .where("a <> b")
        .distinct(),
        "links",
    )
    for _ in range(rounds):
        lowest = links.groupBy("high").agg(F.min("low").alias("to"), F.count("*").alias("n"))
        several = lowest.where("n > 1")
        if several.isEmpty():
            break
        hung = links.join(several.select("high", "to"), "high").where("low <> to").select(F.col("low").alias("high"), F.col("to").alias("low"))
        links = stored(lowest.select("high", F.col("to").alias("low")).unionByName(hung).distinct(), "links")
    else:
        raise RuntimeError(f"components are not found after {rounds} rounds")
    tree = links.select(F.col("high").alias("node"), F.col("low").alias("parent"))
    for _ in range(rounds):
        above = tree.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        jumped = stored(
            tree.join(above, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved")),
            "forest",
        )
        tree = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            break
    roots = tree.select(F.col("parent").alias("node")).distinct().withColumn("parent", F.col("node"))
    return tree.unionByName(roots).select("node", F.col("parent").alias("component"))
