"""Connected components of an edge table by alternating large and small stars, all in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm import common


def _star(edges: DataFrame, both: bool, name: str) -> DataFrame:
    """Edges (u > v) rewritten to each node's smallest neighbour: of all neighbours if both, else of the smaller ones."""
    down = edges.select("u", "v")
    near = down.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else down
    least = common.saved(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
    moved = near.join(least, "u")
    if both:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return common.saved(moved.where("u <> v").groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v"), name)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges(a, b), longs; root is the smallest node reachable, itself included.

    Loops and repeated edges do no harm; rows with a null end are dropped; an empty table gives an empty one. Each round is
    written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    state = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    state = common.saved(state.distinct(), name)
    mark = None
    while True:
        seen = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND((1 << 40) - 1))).first())
        if seen == mark or not seen[0]:
            break
        mark = seen
        state = _star(_star(state, True, name), False, name)
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
