import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phasewell.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, q int, id string, v int"


def brute(rows, k=5):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % 50 == 0:
            got = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q)[:k]
            out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(got)}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    return topk.topk(df, F.col("vec_id") % 50 == 0, 5, **kw)


def vectors(n, width, seed=3):
    rng = np.random.default_rng(seed)
    v = (rng.normal(size=(n, width)) * np.linspace(2, 0.01, width)).astype(np.float32)
    v[n // 3 : 2 * n // 3] = v[0]  # one vector holds a third of all rows
    return [(i, x.tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize("block", [4096, 60])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rows = vectors(400, 12)
    got = [tuple(r) for r in run(spark, rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [1.0]), (7, [0.5, 0.5, 9.0]), (None, [1.0, 1.0]), (50, [-1.0, -2.0])]
    assert {tuple(r) for r in run(spark, rows).collect()} == brute(rows)
    assert {tuple(r) for r in run(spark, [*rows, rows[0]]).collect() if r[0] == 0} == {r for r in brute(rows) if r[0] == 0}


def test_empty_and_large_values(spark):
    assert run(spark, []).collect() == []
    assert run(spark, [(0, [])]).collect() == []
    got = {tuple(r) for r in run(spark, [(0, [1e30]), (1, [1e30]), (2, [-1e30])]).collect()}
    assert got == {(0, 1, 1, 2**63 - 1), (0, 2, 2, 1 - 2**63)}


def test_bounds_prune_but_keep_ties():
    rng = random.Random(1)
    c = np.array([[rng.randint(-9, 9) for _ in range(8)] for _ in range(900)], float)
    ids = np.arange(900)
    rotation = np.linalg.svd(c)[2].T
    threshold = topk.first_thresholds(ids[:5], c[:5], 7, ids[:50], c[:50])
    got = topk.block_topk(ids[:5], c[:5], ids, c, 7, rotation, threshold)
    want = [(q, i, s) for q in range(5) for s, i in sorted((-int(c[q] @ c[i]), i) for i in range(900) if i != q)[:7]]
    assert [(r, i, -s) for r, i, s in got] == want


def test_strata_of_length_leave_out_blocks(spark, monkeypatch):
    """Lengths that fall fast: the result is exact though few query rows are sent to few strata."""
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "SEEDS", 20)
    rng = np.random.default_rng(5)
    rows = [(i, (x / (1 + i % 97)).astype(np.float32).tolist()) for i, x in enumerate(rng.normal(size=(1200, 16)))]
    sent = []
    save = topk.Work.save
    monkeypatch.setattr(topk.Work, "save", lambda self, df, name: sent.append((name, out := save(self, df, name))) or out)
    assert {tuple(r) for r in run(spark, rows).collect()} == brute(rows)
    asked = dict(sent)["asked"].select(F.size("strata").alias("n")).collect()
    assert len(asked) == 24 and sum(r.n for r in asked) < 0.5 * 24 * 30


def test_rows_of_one_query_id_are_one_query(spark):
    rows = [*vectors(120, 6), (50, [3.0] * 6), (100, [1.0] * 6), (100, [1.0] * 6)]
    got = sorted(tuple(r) for r in run(spark, rows).collect())
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [i for i, _ in rows], "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))}))
    assert got == sorted(con.execute(queries.OP1_SQL).fetchall())
    assert [r[1] for r in got if r[0] == 50] == [1, 2, 3, 4, 5]
