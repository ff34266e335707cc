"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum (with map-side partial minima) and a join back on the same
key, which adaptive execution can split where one hub has many edges. Nothing is collected:
the grouped minimum also counts each node's smaller and larger neighbours, which tell that
only stars are left. Rounds grow with the logarithm of the longest path, and each round is
cut by a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.session import discard, materialise


def components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 64) -> DataFrame:
    """(node, component) of every node that has an edge; component is its smallest node.

    edges may hold loops, repeats and either direction; a null end drops the edge. Raises
    where max_rounds did not suffice, as a half-done answer would be wrong.
    """
    now = materialise(
        edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smaller = F.col("v") < F.col("u")
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(smaller).alias("down"), F.count_if(~smaller).alias("up"))
        low = materialise(low.select("u", F.least("m", "u").alias("m"), "down", "up"), "low")
        # Done when all edges lead to the middle of a star, smaller than its leaves.
        if low.filter("down > 1 OR (down = 1 AND up > 0)").isEmpty():
            discard(now)
            return low.select(F.col("u").alias("node"), F.col("m").alias("component"))
        # Larger neighbours move to the smallest of the neighbourhood.
        large = materialise(both.filter(~smaller).join(low.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        discard(now, low)
        lowest = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        # Smaller neighbours, and the node itself, move to the smallest of them.
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        now = materialise(small.filter(F.col("u") != F.col("v")).distinct(), "edges")
        discard(large, lowest)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
