"""Routing by mean phase: buckets, centroids, circular ranges. Approximate by design; exact search is the default.

Centroids are one row a bucket (at most the number of buckets), so they may be broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewell.functions import kernel
from phasewell.operators import query as q
from phasewell.schema import CONFIG, Config, clamp_k


def bucket(center: Column, config: Config = CONFIG) -> Column:
    """Clamped, not wrapped: centres beyond the circle's ends fall into the end buckets."""
    raw = F.floor((center + math.pi) / config.width)
    return F.greatest(F.least(raw, F.lit(config.last_bucket)), F.lit(0)).cast("int")


def placed(table: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Adds phase_center, phase_norm (wrapped) and phase_bucket."""
    center = kernel.phase_center(F.col("phase"))
    return table.withColumn("phase_center", center).withColumn("phase_norm", kernel.wrapped(F.col("phase_center"))).withColumn("phase_bucket", bucket(F.col("phase_center"), config))


def centroids(held: DataFrame) -> DataFrame:
    """phase_bucket, centroid and n of each bucket that has rows."""
    return held.groupBy("phase_bucket").agg(F.avg(kernel.wrapped(F.col("phase_center"))).alias("centroid"), F.count("*").alias("n"))


def circular_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 2 * math.pi - d)


def routed_buckets(held: DataFrame, psi: DataFrame, config: Config = CONFIG) -> tuple[list[int], int]:
    """Buckets near the query's centre (all, if none is near) and how many rows they hold."""
    shards = centroids(held)
    rows = shards.crossJoin(F.broadcast(psi.limit(1).select(kernel.wrapped(kernel.phase_center(F.col("phase"))).alias("_c")))).select("phase_bucket", "n", (circular_distance(F.col("centroid"), F.col("_c")) <= config.epsilon).alias("near")).collect()  # at most one row a bucket
    near = [r for r in rows if r.near] or rows
    return sorted(r.phase_bucket for r in near), sum(r.n for r in near)


def query_routed(held: DataFrame, psi: DataFrame, k: int | None = None, id_col: str = "id", digits: int | None = None, detailed: bool = False, config: Config = CONFIG) -> DataFrame:
    """A query over the routed buckets only; over all if these hold fewer than k rows (top-up)."""
    chosen, n = routed_buckets(held, psi, config)
    scope = held.where(F.col("phase_bucket").isin(chosen)) if n >= clamp_k(k, config) else held
    return (q.query_detailed if detailed else q.query)(scope, psi, k, id_col, digits)


def floor_route(shards: DataFrame, phases: DataFrame, phase_col: str = "phase_norm") -> DataFrame:
    """phases with the bucket of the greatest centroid at or below, else of the first."""
    all_shards = F.broadcast(shards.agg(F.sort_array(F.collect_list(F.struct("centroid", "phase_bucket"))).alias("_s")))  # one row a bucket
    below = F.filter("_s", lambda s: s["centroid"] <= F.col(phase_col))
    return phases.crossJoin(all_shards).withColumn("routed_bucket", F.when(F.size(below) > 0, F.element_at(below, -1)["phase_bucket"]).otherwise(F.get("_s", F.lit(0))["phase_bucket"])).drop("_s")


def hash_route(center: Column, shards: int) -> Column:
    """The alternative mode: the 32-bit hash of the centre's bits, modulo the number of shards."""

    @F.pandas_udf("int")
    def folded(x: pd.Series) -> pd.Series:
        bits = x.to_numpy(np.float64).view(np.uint64)
        return pd.Series(((bits ^ (bits >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))

    return F.pmod(folded(center), F.lit(shards))
