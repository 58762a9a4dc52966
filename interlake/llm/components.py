"""Connected components of an edge table, by alternating large and small stars; nothing comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlake.llm._spark import checkpointed


def connected_components(edges: DataFrame, *, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): every node of an edge with the smallest node it can reach.

    Null ends and loops are ignored. Each round joins every node's neighbours to the smallest of
    them (Kiveris et al., 2014); rounds grow with the logarithm of the longest path.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("u <> v").distinct()
    now, before = checkpointed(now), None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = checkpointed(small.filter("u <> v").distinct())
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
