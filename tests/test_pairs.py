"""Scores of all pairs: row by row against the SQL, on odd inputs, and without a join."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from phasewell.functions import pairscores
from phasewell.operators import pairs
from phasewell.plans import registry

SF = "/root/testdata/sf0.001"
NAN = float("nan")
CLOSED = "compare_closed_form"


#: Lengths differ, some odd; null vectors and components; components that aren't finite, that are zero or huge; opposite and equal ones.
ODD = [[1, 2, 3, 4], [1, 2, 3, 4, 5], None, [1, 2], [], [-1, -2, -3, -4], [None, 2, 3, 4], [1, 2, None, 4], [None, None], [NAN, 1, 2, 3], [float("inf"), 1, 2, 3], [0, 0, 0, 0], [1e20, 1, 1, 1], [3, 0, 0, 4], [0, 1], [0, 0], [1, 2, 3, 4]]


def check(spark, folder, name, vectors, ids=None, labels=None):
    """The query's rows on these vectors and the SQL's are the same; returns them."""
    n = len(vectors)
    table = pa.table({"vec_id": pa.array(ids or [50 * i for i in range(n)], pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(labels or [i % 4 for i in range(n)], pa.int32())})
    pq.write_table(table, f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    got = key(registry.QUERIES[name](spark, str(folder)).collect())
    # SQL's negative zeros are zeros
    assert got == key([(*r[:2], r[2] + 0.0 if r[2] is not None else None) for r in con.execute(registry.ORACLE[name]).fetchall()])
    return got


def plan(spark, name):
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_closed_form_is_worked_out_in_blocks(spark, tmp_path):
    text = plan(spark, CLOSED)
    assert "MapInArrow" in text and "Join" not in text and "CartesianProduct" not in text
    rng = np.random.default_rng(1)
    check(spark, tmp_path, CLOSED, rng.normal(size=(300, 64)).tolist())
    # an odd last element counts; whole numbers bring about ties between two rounded scores
    got = check(spark, tmp_path, CLOSED, [*rng.integers(-3, 4, (200, 5)).tolist(), [1, 0, 0, 0, 0], [NAN, 1, 1, 1, 1], [float("inf"), 1, 1, 1, 1]])
    assert len(got) == 203 * 102
    assert len(check(spark, tmp_path, CLOSED, [[1.0, 0.0]] * 4, [0, 0, None, 7])) == 8  # rows of one id and of none


def test_parts_and_batches_lose_no_pair(spark):
    rows = spark.range(1000).select(F.col("id"), F.array(F.col("id").cast("double") + 1, F.lit(2.0)).alias("vector"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = pairs.all_pairs(rows, rows.where("id % 10 = 0"), pairscores.ClosedForm, "energy", digits=6, part=64)
        assert got.count() == got.select("query_id", "id").distinct().count() == 100_000
        assert got.where("query_id = id").select(F.min("energy")).first()[0] == 1.0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert pairs.all_pairs(rows.limit(0), rows.limit(0), pairscores.ClosedForm).count() == 0
    assert pairs.all_pairs(rows, rows.limit(0), pairscores.ClosedForm).count() == 0


@pytest.mark.parametrize(("x", "want"), [(0.0078125, 0.007813), (-0.0078125, -0.007813), (0.49999999e-6, 0.0), (-1e-9, 0.0), (1.5, 1.5), (NAN, NAN), (float("inf"), float("inf"))])
def test_rounding_is_that_of_sql(x, want):
    got = pairscores.rounded(np.array([x]), 6)[0]
    assert repr(float(got)) == repr(want)


def test_ignore_phase_matches_sql(spark, tmp_path):
    assert "Join" not in plan(spark, "compare_ignore_phase")
    assert len(check(spark, tmp_path, "compare_ignore_phase", ODD)) == 17 * 9
    # amplitudes of whole numbers: ties between two rounded scores
    rng = np.random.default_rng(2)
    check(spark, tmp_path, "compare_ignore_phase", [[x, 0.0, 0.0, y] for x, y in rng.integers(-4, 5, (300, 2)).tolist()], labels=[0] * 300)


def test_mean_delta_matches_sql(spark, tmp_path):
    assert "Join" not in plan(spark, "mean_phase_delta")
    assert len(check(spark, tmp_path, "mean_phase_delta", ODD)) == 17 * 9


def test_mean_delta_of_any_phases(spark):
    """Phases beyond a turn, as a table of patterns may have them, against the column kernel."""
    p = np.random.default_rng(3).uniform(-20, 20, (60, 7))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "id long, phase array<double>")
    got = {(r.query_id, r.id): r.score for r in pairs.all_pairs(rows, rows, pairscores.MeanDelta).collect()}
    d = np.abs(np.arctan2(np.sin(p[None] - p[:, None]), np.cos(p[None] - p[:, None]))).mean(2)
    assert len(got) == 3600 and max(abs(got[i, j] - d[i, j]) for i, j in got) < 1e-12


def test_phase_delta_matches_sql(spark, tmp_path):
    assert "Join" not in plan(spark, "phase_delta_pairs")
    assert len(check(spark, tmp_path, "phase_delta_pairs", ODD)) == 17 * 9
    # opposite directions, where the sign of next to nothing chooses between pi and -pi
    rng = np.random.default_rng(4)
    some = rng.integers(-2, 3, (60, 4))
    check(spark, tmp_path, "phase_delta_pairs", [*some.tolist(), *(-some).tolist()])


def test_compare_matches_sql(spark, tmp_path):
    assert "Join" not in plan(spark, "compare_pairs")
    assert len(check(spark, tmp_path, "compare_pairs", ODD)) == 17 * 9
    check(spark, tmp_path, "compare_pairs", np.random.default_rng(5).normal(size=(400, 64)).tolist())
    # whole numbers along the axes: ties between two rounded scores
    some = np.random.default_rng(6).integers(-3, 4, (200, 2))
    check(spark, tmp_path, "compare_pairs", [[x, 0, 0, y] for x, y in some.tolist()], labels=[0] * 200)
