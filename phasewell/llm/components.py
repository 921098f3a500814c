"""Connected components by alternating large-star and small-star steps.

Every step is two plain joins over tables in the shared folder, so hot nodes are split by Spark's skew
join and a lost executor costs a re-read. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work


def components(work: Work, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node that a link names; component is the smallest node reachable.

    Self links, repeated and reversed links and nulls are allowed and change nothing.
    """
    x, y = F.col(a), F.col(b)
    edges = work.save(links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "cc-0")
    step, before = 0, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = work.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"low-{step}")
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = work.save(large.where("u != v").distinct(), f"large-{step}")
        least = work.save(large.groupBy("u").agg(F.min("v").alias("m")), f"least-{step}")
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = work.save(small, f"cc-{step + 1}")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (f"cc-{step}", f"low-{step}", f"large-{step}", f"least-{step}"):
            work.drop(old)
        step += 1
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
