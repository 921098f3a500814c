"""Exact top-k inner-product search over norm-sorted blocks.

Candidates are dealt into strata of descending length, each stratum into blocks. In the space rotated by the right
singular vectors of a bounded sample, a vector is cut into leading parts of growing size and a residual; a stratum keeps
its largest length and, for each cut, its largest leading and residual lengths. A query's first threshold is its k-th
best score among the longest vectors of the whole table. By Cauchy-Schwarz it is sent only to strata whose bound reaches
that threshold, and blocks of queries are dealt by how short a vector may be and still matter, so that blocks of few
queries' interest meet few queries. Inside a task candidates go by descending length. A query leaves the scan when
|q| * |c| falls below its threshold; partial sums over the cuts, each plus |q_residual| * |c_residual|, drop pairs step by
step; only pairs whose last bound reaches the threshold get their exact integer score.

Edge cases. A vector that is null or has a null or non-finite component takes no part, nor does a row
without an id. Vectors of different lengths compare over their common leading components (the shorter
one counts as padded with zeros); an empty vector scores 0. Query rows of one id are one query with several vectors:
a candidate row is scored against each different one, and the k best of all scores are returned; exact repeats of a
query row change nothing. A repeated candidate row is a candidate each time; rows that share a query's id are the
query's own. Ties go to the smaller id. Scores beyond 2**63 - 1 either way are clipped to it. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, tasks_for

#: Parameters: scale of quantisation; rows in a block of candidates and of queries; longest vectors
#: that seed the thresholds; vectors sampled for the rotation; candidates scored at a time; strata of length at most;
#: shares of the dimensions at which partial sums are bounded.
SCALE = 256.0
CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 2048
SEEDS = 256
ROTATION_SAMPLE = 2048
CHUNK = 512
STRATA = 256
CUTS = (0.125, 0.25, 0.5)
EXACT = float(2**52)

PAIR_SCHEMA = "query_id long, vec_id long, score long"


def matrix(column, width: int) -> np.ndarray:
    """Floor(SCALE * x) of a list column as float64 rows, padded with zeros to width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of q and c, exact; beyond 2**52 through Python integers, clipped to a long."""
    if (np.linalg.norm(q, axis=1).max(initial=0) * np.linalg.norm(c, axis=1).max(initial=0)) < EXACT:
        return (q @ c.T).astype(np.int64)
    to_int = np.vectorize(int, otypes=[object])
    exact = to_int(q) @ to_int(c).T
    return np.clip(exact, 1 - 2**63, 2**63 - 1).astype(np.int64)


def cuts_of(width: int) -> list[int]:
    return sorted({max(1, int(c * width)) for c in CUTS})


def parts_of(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the leading part and of the residual at each cut: two arrays of rows by cuts."""
    square = np.cumsum(rotated * rotated, axis=1)
    at = [c - 1 for c in cuts_of(rotated.shape[1])]
    return np.sqrt(square[:, at]), np.sqrt(np.maximum(square[:, -1:] - square[:, at], 0.0))


def slack_of(q_len, c_len):
    """Room for rounding in bounds of vectors of these lengths."""
    return 1.0 + 1e-9 * q_len * c_len


def first_thresholds(q_ids, q, k, seed_ids, seeds) -> np.ndarray:
    """The k-th best score of each query among the seeds; no bound if they are too few."""
    if len(seeds) <= k or not len(q):
        return np.full(len(q), -np.inf)
    first = scores(q, seeds).astype(np.float64)
    first[q_ids[:, None] == seed_ids[None, :]] = -np.inf
    return -np.partition(-first, k - 1, axis=1)[:, k - 1]


def block_topk(q_ids, q, c_ids, c, k, rotation, threshold):
    """Row numbers of queries, candidate ids and scores of the k best of each query inside this block."""
    cuts = cuts_of(q.shape[1])
    q_len, c_len = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    order = np.lexsort((c_ids, -c_len))
    c_ids, c, c_len = c_ids[order], c[order], c_len[order]
    q_rot, c_rot = q @ rotation, c @ rotation
    q_tail, c_tail = parts_of(q_rot)[1], parts_of(c_rot)[1]
    threshold = threshold.copy()
    best = [[] for _ in q]  # (negative score, id), at most k, sorted
    for at in range(0, len(c), CHUNK):
        part = slice(at, at + CHUNK)
        slack = slack_of(q_len, c_len[at])
        live = np.flatnonzero(q_len * c_len[at] + slack >= threshold)
        if not len(live):
            break  # lengths only fall from here, thresholds only rise
        cols, partial, done = np.arange(at, min(at + CHUNK, len(c))), 0.0, 0
        for n, cut in enumerate(cuts):  # partial sums over growing leading parts; rows and columns without hope leave
            partial = partial + q_rot[live, done:cut] @ c_rot[cols, done:cut].T
            done = cut
            reach = partial + np.outer(q_tail[live, n], c_tail[cols, n]) + slack[live, None] >= threshold[live, None]
            rows, some = reach.any(axis=1), reach.any(axis=0)
            live, cols, partial, reach = live[rows], cols[some], partial[rows][:, some], reach[rows][:, some]
            if not len(live):
                break
        if not len(live):
            continue
        reach &= q_ids[live, None] != c_ids[None, cols]
        exact = scores(q[live], c[cols])
        for r, row, ok in zip(live.tolist(), exact, reach, strict=True):
            found = np.flatnonzero(ok & (row >= threshold[r]))
            if len(found) > k:
                found = found[np.lexsort((c_ids[cols][found], -row[found]))[:k]]
            best[r] = sorted(best[r] + list(zip((-row[found]).tolist(), c_ids[cols][found].tolist(), strict=True)))[:k]
            if len(best[r]) == k:
                threshold[r] = max(threshold[r], -best[r][-1][0])
    return [(r, vec, -s) for r, b in enumerate(best) for s, vec in b]


def topk(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best candidates of each query row: query_id, rank (from 1), vec_id, score."""
    spark = df.sparkSession
    work = Work(spark, "topk")
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.floor(x * SCALE) * F.floor(x * SCALE).cast("double"))
    rows = base.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite).withColumn("length", F.sqrt(square))
    n, n_queries, width = rows.agg(F.count("*"), F.sum(F.col("q").cast("long")), F.max(F.size("v"))).first()
    width = max(width or 0, 1)

    def bounded(order, limit):
        got = rows.orderBy(*order).limit(limit).select("id", "v").collect()
        return np.array([r[0] for r in got], np.int64), matrix(pa.array([r[1] for r in got], pa.list_(pa.float64())), width)

    seed_ids, seeds = bounded([F.col("length").desc(), F.col("id")], SEEDS)
    _, sample = bounded([F.xxhash64("id"), F.col("id")], ROTATION_SAMPLE)
    rotation = np.linalg.svd(sample / max(1.0, np.abs(sample).max(initial=0)), full_matrices=True)[2].T if 0 < len(sample) else np.eye(width)
    strata = max(1, min(STRATA, -(-n // CANDIDATE_BLOCK)))
    edges = np.array(sorted(set(rows.approxQuantile("length", [i / strata for i in range(1, strata)], 1 / (4 * strata)))) if strata > 1 else [], float)
    stratum = lambda x: len(edges) - np.searchsorted(edges, x, "right")  # noqa: E731  # 0: the longest
    cuts = len(cuts_of(width))
    shared = spark.sparkContext.broadcast((rotation, seed_ids, seeds, edges))  # bounded by SEEDS, STRATA and the width

    def largest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(stratum, rows, largest length, leading and residual lengths at each cut)."""
        rotation = shared.value[0]
        top: dict[int, np.ndarray] = {}
        for b in parts:
            v = matrix(b.column(0), width)
            lead, tail = parts_of(v @ rotation)
            figures = np.column_stack([np.linalg.norm(v, axis=1), lead, tail])
            at = stratum(b.column(1).to_numpy())
            for s in np.unique(at):
                mine = figures[at == s]
                held = top.setdefault(int(s), np.zeros(2 + 2 * cuts))
                held[0] += len(mine)
                held[1:] = np.maximum(held[1:], mine.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([*top], pa.int32()), pa.array([x[0] for x in top.values()], pa.float64()), pa.array([x[1:].tolist() for x in top.values()], pa.list_(pa.float64()))], names=["s", "n", "top"])

    figures = rows.select("v", "length").mapInArrow(largest, "s int, n double, top array<double>")
    found = figures.groupBy("s").agg(F.sum("n").alias("n"), *[F.max(F.get("top", F.lit(i))).alias(f"t{i}") for i in range(1 + 2 * cuts)]).collect()  # at most STRATA rows
    tops = np.zeros((len(edges) + 1, 1 + 2 * cuts))
    blocks = np.ones(len(edges) + 1, np.int64)
    for r in found:
        tops[r.s], blocks[r.s] = [r[f"t{i}"] for i in range(1 + 2 * cuts)], max(1, -(-int(r.n) // CANDIDATE_BLOCK))

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Query rows with their first threshold, the strata whose bound reaches it, and the length a candidate needs."""
        rotation, seed_ids, seeds, _ = shared.value
        for b in parts:
            ids, q = b.column(0).to_numpy(), matrix(b.column(1), width)
            threshold = first_thresholds(ids, q, k, seed_ids, seeds)
            q_len, (lead, tail) = np.linalg.norm(q, axis=1), parts_of(q @ rotation)
            bound = np.minimum(q_len[:, None] * tops[None, :, 0], (lead[:, None, :] * tops[None, :, 1 : 1 + cuts] + tail[:, None, :] * tops[None, :, 1 + cuts :]).min(axis=2))
            reach = bound + slack_of(q_len[:, None], tops[None, :, 0]) >= threshold[:, None]
            needs = np.where(q_len > 0, threshold / np.maximum(q_len, 1e-300), -np.inf)
            to = pa.array([np.flatnonzero(r).tolist() for r in reach], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(threshold), pa.array(np.nan_to_num(needs, neginf=-1e300)), to], names=["id", "v", "threshold", "needs", "strata"])

    asked = work.save(rows.where("q").select("id", "v").mapInArrow(send, "id long, v array<double>, threshold double, needs double, strata array<int>"), "asked")
    n_q = max(1, -(-(n_queries or 0) // QUERY_BLOCK))
    # alike in what they need, queries of one block visit the same strata; at most STRATA ranges, cut further by a hash
    ranges = min(n_q, STRATA)
    marks = sorted(set(asked.approxQuantile("needs", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    rank = F.size(F.filter(F.lit(marks).cast("array<double>"), lambda m: m <= F.col("needs"))) if marks else F.lit(0)
    deal = lambda salt, count: F.pmod(F.xxhash64("id", F.lit(salt)), count).cast("int")
    per_range = -(-n_q // (len(marks) + 1))
    routed = asked.select(F.explode("strata").alias("s"), (rank * per_range + deal(2, F.lit(per_range))).cast("int").alias("qb"), "id", "v", "threshold")
    in_blocks = F.get(F.lit(blocks.tolist()).cast("array<bigint>"), F.col("s"))
    queries = routed.withColumn("cb", F.explode(F.sequence(F.lit(0), (in_blocks - 1).cast("int")))).select("s", "cb", "qb", F.lit(True).alias("asks"), "id", "v", "threshold")

    level = F.lit(len(edges)) - F.size(F.filter(F.lit(edges.tolist()).cast("array<double>"), lambda e: e <= F.col("length"))) if len(edges) else F.lit(0)
    placed = rows.select(level.cast("int").alias("s"), "id", "v", F.monotonically_increasing_id().alias("place"))
    placed = placed.withColumn("cb", F.pmod(F.xxhash64("id", "place"), in_blocks).cast("int"))  # a repeated row is dealt out too
    wanted = work.save(routed.select("s", "qb").distinct(), "wanted")  # pairs of strata and query blocks that meet
    candidates = placed.join(wanted, "s").select("s", "cb", "qb", F.lit(False).alias("asks"), "id", "v", F.lit(0.0).alias("threshold"))

    def meet(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy().astype(bool)
        ids, v = table["id"].to_numpy(), matrix(table["v"], width)
        q_ids, q, threshold = ids[asks], v[asks], table["threshold"].to_numpy()[asks]
        if len(q_ids) > len(np.unique(q_ids)):
            first = np.unique(np.column_stack([q_ids, q]), axis=0, return_index=True)[1]
            q_ids, q, threshold = q_ids[first], q[first], threshold[first]
        found = block_topk(q_ids, q, ids[~asks], v[~asks], k, shared.value[0], threshold) if len(q) and not asks.all() else []
        return pa.table({"query_id": pa.array([int(q_ids[r]) for r, _, _ in found], pa.int64()), "vec_id": pa.array([v for _, v, _ in found], pa.int64()), "score": pa.array([s for _, _, s in found], pa.int64())})

    tasks = tasks_for(spark, int(blocks.sum()) * n_q, 8)
    met = candidates.unionByName(queries).repartition(tasks, "s", "cb", "qb").groupBy("s", "cb", "qb").applyInArrow(meet, PAIR_SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
