"""Nodes reachable along edges, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tautline.functions.durable import durable
from tautline.operators.sized import sized

#: Rounds after which the tables of what was reached are written as one.
MERGE = 8


def closure(starts: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """starts (root, node), edges (src, dst) -> root, node, depth: the least number of steps from each root; cycles end by the visited
    set. The edges and each round are written to the shared folder, and what was reached is written together every MERGE rounds, so
    that no plan grows with the depth; without max_depth the rounds end when nothing new is reached. Only a front that is counted to be small is broadcast."""
    edges = durable(edges.select("src", "dst").distinct(), "edges")
    seen = front = durable(starts.select("root", "node").distinct().withColumn("depth", F.lit(0)), "front")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = sized(front).join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        front = durable(step.join(seen.select("root", "node").hint("merge"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if depth % MERGE == 0:
            seen = durable(seen, "seen")
    return seen
