"""Connected components of an edge table, in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, scratch, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node and component (its smallest node), for every node of an edge.

    Alternates large-star and small-star steps: each links a node's neighbours to the least
    among them, so labels halve their distance to the root and a hub never meets all pairs.
    Every round is a written table; it ends when a round changes nothing,
    and fails if ``rounds`` are not enough.
    """
    own = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, before = scratch.write(own, "edges0"), None
    for i in range(1, rounds + 1):
        # large star: a node's greater neighbours point to the least of its neighbours and itself
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its lesser neighbours point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.write(small, f"edges{i}")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before, now = tuple(state), after
        if i > 1:
            scratch.drop(f"edges{i - 2}")
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    labels = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return labels.unionByName(roots.join(labels.select("node"), "node", "left_anti"))
