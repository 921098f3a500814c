"""Deriving, validating and superposing patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewell.functions import kernel
from phasewell.schema import CONFIG, Config, InvalidPattern


def fold(df: DataFrame, vector: str = "embedding", scale: Column | None = None) -> DataFrame:
    """Adds amplitude, phase and energy_total: component i is made of elements 2i and 2i + 1 of a real vector.

    The work grows with the vector's length: the array is cast and split once a row. An odd last element is left out.
    """
    v = F.col(vector).cast("array<double>")
    every_other = lambda k: F.slice(F.filter(v, lambda x, i: i % 2 == k), 1, F.greatest(F.floor(F.size(vector) / 2).cast("int"), F.lit(0)))
    amp = F.zip_with(every_other(0), every_other(1), lambda x, y: F.sqrt(x * x + y * y))
    phase = F.zip_with(every_other(0), every_other(1), lambda x, y: F.atan2(y, x))
    if scale is not None:
        amp = F.transform(F.arrays_zip(amp.alias("a"), F.array_repeat(scale, F.size(amp)).alias("s")), lambda z: z["a"] * z["s"])
    out = df.withColumns({"amplitude": amp, "phase": phase})
    return out.withColumn("energy_total", kernel.energy_total(F.col("amplitude")))


def checked(amplitude, phase, length: int | None = None, config: Config = CONFIG) -> tuple[list[float], list[float]]:
    """One pattern's arrays as lists of floats; raises InvalidPattern."""
    if amplitude is None or phase is None:
        raise InvalidPattern("amplitude and phase are required")
    if len(amplitude) != len(phase) or len(amplitude) > config.longest or not len(amplitude):
        raise InvalidPattern(f"lengths {len(amplitude)} and {len(phase)}")
    if length is not None and len(amplitude) != length:
        raise InvalidPattern(f"length {len(amplitude)}, the store has {length}")
    return [float(x) for x in amplitude], [float(x) for x in phase]


def superpose(df: DataFrame, weight: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """One pattern (a group): the weighted sum of complex components, position by position, not normalised."""
    by = by or []
    parts = df.select(*by, (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"), F.posexplode(F.arrays_zip("amplitude", "phase")).alias("pos", "c"))
    sums = parts.groupBy(*by, "pos").agg(F.sum(F.col("w") * F.col("c.amplitude") * F.cos("c.phase")).alias("re"), F.sum(F.col("w") * F.col("c.amplitude") * F.sin("c.phase")).alias("im"))
    ordered = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", F.hypot("re", "im").alias("a"), F.atan2("im", "re").alias("f")))).alias("s"))
    return ordered.select(*by, F.transform("s", lambda x: x["a"]).alias("amplitude"), F.transform("s", lambda x: x["f"]).alias("phase"))


def weights_for(n: int, weights: list[float] | None) -> list[float]:
    """Missing or empty weights are all 1; another number of weights than patterns is an error."""
    if not n:
        raise ValueError("no patterns to superpose")
    if not weights:
        return [1.0] * n
    if len(weights) != n:
        raise ValueError(f"{n} patterns but {len(weights)} weights")
    return [float(w) for w in weights]
