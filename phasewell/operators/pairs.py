"""Scores of all queries against all rows of a table: every pair is a row of the result, so it grows with both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewell.functions import pairscores

#: Pairs that a batch of the result holds, about.
BATCH = 1 << 15


def all_pairs(table: DataFrame, queries: DataFrame, kind, score: str = "score", id_col: str = "id", digits: int | None = None, part: int = 4096) -> DataFrame:
    """query_id, id and score of each query with each row; both sides have id_col and kind's array columns.

    The table is dealt into parts of bounded size, by position, so that repeated ids don't crowd one. A task keeps one part
    and lets the queries pass in Arrow batches; a matrix product scores some of them at a time. Nothing is broadcast.
    """
    parts = max(1, -(-table.count() // part))
    lean = lambda df, asks: df.select(F.lit(asks).alias("asks"), F.col(id_col).alias("i"), *kind.columns)
    held = lean(table, False).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int"))
    asked = lean(queries, True).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    id_type = table.schema[id_col].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, sides = [], None
        for batch in batches:
            asks = batch["asks"].to_numpy(zero_copy_only=False).astype(bool)
            first = len(asks) - int(asks.sum())  # the table's rows come before the queries
            if first:
                kept.append(batch.slice(0, first))
            if first == len(asks) or not kept:
                continue
            if sides is None:
                rows = pa.Table.from_batches(kept)
                ids = rows["i"].combine_chunks()
                sides = [(c, ids.take(pa.array(at))) for at, c in pairscores.blocks(kind, rows)]
                del rows
            yield from met(pa.Table.from_batches([batch.slice(first)]), sides)

    def met(asked: pa.Table, sides: list) -> Iterator[pa.RecordBatch]:
        ids = asked["i"].combine_chunks()
        for at, q in pairscores.blocks(kind, asked):
            for c, c_ids in sides:
                step = max(1, BATCH // len(c_ids))
                again = c_ids.take(pa.array(np.tile(np.arange(len(c_ids)), min(step, len(at)))))
                for start in range(0, len(at), step):
                    some = np.arange(start, min(start + step, len(at)))
                    x, none = pairscores.scores(kind, q and q.take(slice(start, start + step)), c, (len(some), len(c_ids)), digits)
                    columns = [ids.take(pa.array(np.repeat(at[some], len(c_ids)))), again.slice(0, x.size), pa.array(x.ravel(), mask=None if none is None else none.ravel())]
                    yield pa.RecordBatch.from_arrays(columns, names)

    names = ["query_id", id_col, score]
    dealt = held.unionByName(asked).repartitionById(parts, "part").drop("part").sortWithinPartitions("asks")
    return dealt.mapInArrow(meet, f"query_id {id_type}, `{id_col}` {id_type}, `{score}` double")
