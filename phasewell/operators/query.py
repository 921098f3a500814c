"""Similarity queries: exact by a pruned scan, scoring and a distributed top-k; approximate through routing.

The table has an id column, amplitude, phase and optionally energy_total. The query is a one-row DataFrame with
amplitude, phase (and the id column: its own id). Only one row is broadcast. Energies are single-precision floats, and
so are the priorities that rank (digits: doubles rounded to so many decimals instead). NaN energies, from patterns with
components that aren't finite, rank behind all others. An id should stand once in the table; distinct=True makes one
row of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasewell.functions import kernel
from phasewell.schema import clamp_k


def one_query(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Query columns under names of their own; one row."""
    own = F.col(id_col) if id_col in df.columns else F.lit(None)
    return df.limit(1).select(own.alias("_q_id"), F.col("amplitude").alias("_q_amp"), F.col("phase").alias("_q_phase"), kernel.energy_total(F.col("amplitude")).alias("_q_total"))


def scored(table: DataFrame, query: DataFrame, id_col: str = "id", digits: int | None = None, detailed: bool = False, ignore_phase: bool = False) -> DataFrame:
    """table with energy (and phase_delta, zone, zone_score) and priority; candidates of another length are skipped."""
    q = F.broadcast(one_query(query, id_col))
    cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c.cast("float"))
    number = "double" if digits is not None else "float"
    held = table if "energy_total" in table.columns else table.withColumn("energy_total", kernel.energy_total(F.col("amplitude")))
    met = held.crossJoin(q).where((F.size("amplitude") == F.size("_q_amp")) & (F.size("phase") == F.size("_q_phase")))
    energy = kernel.compare_ignore_phase(F.col("_q_amp"), F.col("amplitude")) if ignore_phase else kernel.compare(F.col("_q_amp"), F.col("_q_phase"), F.col("amplitude"), F.col("phase"), F.col("_q_total"), F.col("energy_total"))
    met = met.withColumn("energy", cut(energy))
    own = F.coalesce((F.col(id_col) == F.col("_q_id")).cast(number), F.lit(0.0).cast(number))
    priority = F.col("energy") + own + (F.lit(0.5) * kernel.is_exact(F.col("energy")).cast("double")).cast(number)
    if detailed:
        met = met.withColumn("phase_delta", cut(kernel.phase_delta(F.col("_q_phase"), F.col("phase"))))
        met = met.withColumn("zone", kernel.zone(F.col("energy"), F.col("phase_delta"))).withColumn("zone_score", kernel.zone_score(F.col("zone")))
        priority = priority + F.col("zone_score").cast(number)
    return met.withColumn("priority", priority).drop("_q_id", "_q_amp", "_q_phase", "_q_total")


def ranking(id_col: str) -> list[Column]:
    number = lambda c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)).desc_nulls_last()
    return [number("priority"), number("energy"), F.col(id_col).asc()]


def best(met: DataFrame, k: int | None, id_col: str, distinct: bool) -> DataFrame:
    if distinct:  # rows of one id: the best of them, summed up before the shuffle
        others = [c for c in met.columns if c != id_col]
        nan_last = F.struct(F.coalesce(F.nanvl("priority", F.lit(float("-inf"))), F.lit(float("-inf"))), F.col("energy"))
        met = met.groupBy(id_col).agg(F.max_by(F.struct(*others), nan_last).alias("_x")).select(id_col, "_x.*")
    return met.orderBy(*ranking(id_col)).limit(clamp_k(k))


def query(table: DataFrame, psi: DataFrame, k: int | None = None, id_col: str = "id", digits: int | None = None, ignore_phase: bool = False, distinct: bool = False) -> DataFrame:
    """The k best by energy, an exact or own match first."""
    return best(scored(table, psi, id_col, digits, ignore_phase=ignore_phase), k, id_col, distinct)


def query_detailed(table: DataFrame, psi: DataFrame, k: int | None = None, id_col: str = "id", digits: int | None = None, ignore_phase: bool = False, distinct: bool = False) -> DataFrame:
    """The k best by zone and energy, with phase_delta, zone and zone_score."""
    return best(scored(table, psi, id_col, digits, True, ignore_phase), k, id_col, distinct)


def query_arrow(table: DataFrame, amplitude: list[float], phase: list[float], k: int | None = None, id_col: str = "id", digits: int | None = None) -> DataFrame:
    """id, energy and phase_delta of the k best of one query, scored by the Arrow-batched numpy kernel (for long patterns)."""
    same = table.where((F.size("amplitude") == len(amplitude)) & (F.size("phase") == len(amplitude)))
    s = same.select(id_col, kernel.score_udf(amplitude, phase)("amplitude", "phase").alias("s"))
    cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c.cast("float"))
    met = s.select(id_col, cut(F.col("s.energy")).alias("energy"), cut(F.col("s.phase_delta")).alias("phase_delta"))
    met = met.withColumn("priority", F.col("energy") + (F.lit(0.5) * kernel.is_exact(F.col("energy")).cast("double")))
    return met.orderBy(*ranking(id_col)).limit(clamp_k(k)).drop("priority")


def interference_entries(table: DataFrame, psi: DataFrame, k: int | None = None, id_col: str = "id", digits: int | None = None) -> DataFrame:
    """query_detailed with phase_delta as phase_shift and without zone_score."""
    return query_detailed(table, psi, k, id_col, digits).withColumnRenamed("phase_delta", "phase_shift").drop("zone_score")


def interference(table: DataFrame, psi: DataFrame, k: int | None = None, id_col: str = "id", digits: int | None = None) -> DataFrame:
    """One row: the query and its matches (at most k) in order."""
    best = query_detailed(table, psi, k, id_col, digits)
    entry = F.struct((-F.col("priority")).alias("o1"), (-F.col("energy")).alias("o2"), F.col(id_col), "energy", "phase_delta", "zone", "zone_score", "amplitude", "phase")
    row = best.agg(F.sort_array(F.collect_list(entry)).alias("m"))
    matches = F.transform("m", lambda x: x.dropFields("o1", "o2")).alias("matches")
    return psi.limit(1).select(F.struct("amplitude", "phase").alias("query")).crossJoin(F.broadcast(row.select(matches)))


def query_batch(table: DataFrame, queries: DataFrame, k: int, id_col: str = "id", digits: int | None = None, block: int = 512) -> DataFrame:
    """The k best for each of many queries (whose ids differ): query_id, rank, id, energy and priority.

    Blocks of queries meet parts of the table, all of bounded size, in Arrow batches: one matrix product scores a block
    against a part, and only the k best of each query leave it. Nothing that grows is broadcast.
    """
    spark = table.sparkSession
    n_queries, n_rows = queries.count(), table.count()
    blocks, parts = max(1, -(-n_queries // block)), max(1, -(-n_rows // (8 * block)))
    kind = table.schema[id_col].dataType
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("i"), F.lit(n)).cast("int")
    narrow = lambda df, asks: df.select(F.lit(asks).alias("asks"), F.col(id_col).alias("i"), F.col("amplitude").alias("a"), F.col("phase").alias("p")).where("size(a) = size(p)")
    asked = narrow(queries, True).select(deal(blocks).alias("b"), every(parts).alias("c"), "asks", "i", "a", "p")
    held = narrow(table, False).select(every(blocks).alias("b"), deal(parts).alias("c"), "asks", "i", "a", "p")

    def meet(rows: pa.Table) -> pa.Table:
        asks, ids, sizes = rows["asks"].to_numpy().astype(bool), rows["i"].combine_chunks(), rows["a"].combine_chunks().value_lengths().to_numpy()
        out: list[tuple] = []
        for size in np.unique(sizes[asks]):
            q, c = np.flatnonzero(asks & (sizes == size)), np.flatnonzero(~asks & (sizes == size))
            if not len(c):
                continue
            amp = lambda at: rows["a"].combine_chunks().take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)
            turn = lambda at: rows["p"].combine_chunks().take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)
            energy = kernel.energies(amp(q), turn(q), amp(c), turn(c))
            energy = np.round(energy, digits) if digits is not None else energy.astype(np.float32)
            own = np.array(ids.take(pa.array(q)).to_pylist(), object)[:, None] == np.array(ids.take(pa.array(c)).to_pylist(), object)[None, :]
            priority = energy + own.astype(energy.dtype) + energy.dtype.type(0.5) * (energy > kernel.EXACT_ENERGY)
            for r in range(len(q)):
                score = np.where(np.isnan(priority[r]), -np.inf, priority[r])
                some = np.arange(len(c)) if len(c) <= k else np.flatnonzero(score >= -np.partition(-score, k - 1)[k - 1])
                out += [(q[r], c[x], energy[r, x], priority[r, x]) for x in some]
        at = lambda j: pa.array(np.array([o[j] for o in out], np.int64))
        return pa.table({"query_id": ids.take(at(0)), id_col: ids.take(at(1)), "energy": pa.array([float(o[2]) for o in out], pa.float64()), "priority": pa.array([float(o[3]) for o in out], pa.float64())})

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks * parts // 4))
    met = asked.unionByName(held).repartition(tasks, "b", "c").groupBy("b", "c").applyInArrow(meet, f"query_id {kind.simpleString()}, {id_col} {kind.simpleString()}, energy double, priority double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*ranking(id_col)))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def materialise(best: DataFrame, table: DataFrame, id_col: str = "id") -> DataFrame:
    """Arrays back onto a narrow result of at most top_k_max rows."""
    return table.join(F.broadcast(best), id_col)


def contains_exact(table: DataFrame, wanted: DataFrame, id_col: str = "id") -> DataFrame:
    """wanted's ids with found: whether the table has the id."""
    have = table.select(id_col).distinct().withColumn("found", F.lit(True))
    return wanted.select(id_col).join(have, id_col, "left").withColumn("found", F.coalesce("found", F.lit(False)))
