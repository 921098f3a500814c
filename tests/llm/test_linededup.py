import re
from collections import Counter

import pytest

from phasewell.llm import linededup
from phasewell.llm.common import Work

from . import docs

A_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least=10):
    split = [(r, (r[1] or "").split("\n")) for r in rows]
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(A_Z)
    n = Counter(k for _, ls in split for k in {key(x) for x in ls} if k)
    out = []
    for r, ls in split:
        kept = [x for x in ls if n[key(x)] < least]
        out.append((r[0], "\n".join(kept), *r[2:], len(ls), len(ls) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("keys", "batches", "counted"), [(10**6, 3, 10**6), (0, 1, 5), (0, 7, 5)])
def test_brute_force(spark, monkeypatch, keys, batches, counted):
    monkeypatch.setattr(linededup, "BATCHES", batches)
    monkeypatch.setattr(linededup, "COUNTED", counted)
    table = docs.table(spark)
    got = linededup.drop_common_lines(table, broadcast_keys=keys)
    assert got.columns == [*table.columns, "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs.rows())


def test_empty(spark):
    assert linededup.drop_common_lines(docs.empty(spark)).collect() == []


def test_runs_by_batches(spark):
    work = Work(spark, "t")
    runs = linededup.LineRuns(spark, work.path("runs"), 5, 2)
    total = Counter()
    for k in range(7):
        part = [(h, -h, 1 + (h + k) % 3) for h in range(k, k + 6)]
        total.update({h: n for h, _, n in part})
        runs.add(spark.createDataFrame(part, "h1 long, h2 long, n long"))
        assert {r.h1 for r in runs.common().collect()} == {h for h, n in total.items() if n >= 5}
    found = runs.runs()
    assert found == sorted(found) and len(found) <= 3 and max(r[0] for r in found) == 2
    assert {b for _, lo, hi, _ in found for b in range(lo, hi + 1)} == set(range(7))


def test_cut_short_merge_counts_once(spark):
    work = Work(spark, "t")
    runs = linededup.LineRuns(spark, work.path("runs"), 4, 2, buckets=3)
    one = spark.createDataFrame([(1, 1, 2)], "h1 long, h2 long, n long")
    runs.write(one, (0, 0, 0, 3))
    runs.write(one, (0, 1, 1, 3))
    runs.write(spark.createDataFrame([(1, 1, 4)], "h1 long, h2 long, n long"), (1, 0, 1, 3))  # its inputs weren't deleted yet
    assert runs.runs() == [(1, 0, 1, 3)]
    assert runs.common().count() == 1
    again = linededup.LineRuns(spark, work.path("runs"), 4, 2)  # reopened
    assert again.buckets == 3 and again.common().count() == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batches_meet_runs_by_merge_joins(spark):
    work = Work(spark, "t")
    runs = linededup.LineRuns(spark, work.path("runs"), 5, 3, buckets=4)
    batch = spark.range(1000).selectExpr("id AS h1", "id * 7 AS h2", "id % 7 AS n")
    runs.add(batch)
    runs.add(batch)
    anti, merge = plan_of(runs.fresh(batch)), plan_of(runs.merged(runs.runs()))
    assert anti.count("SortMergeJoin") == 2 and anti.count("LeftAnti") == 2 and merge.count("SortMergeJoin") == 1 and "FullOuter" in merge
    assert anti.count("Exchange") == 1 and "Exchange" not in merge  # the batch is dealt once, runs never
    assert "BroadcastHashJoin" not in anti + merge


def test_clashing_names(spark):
    given = docs.table(spark).selectExpr("*", "7 AS n_lines", "7 AS rest", "7 AS `a.b`", "7 AS h2", "7 AS batch", "7 AS salt")
    for keys in (10**6, 0):
        got = linededup.drop_common_lines(given, broadcast_keys=keys)
        assert got.columns == [*[c for c in given.columns if c != "n_lines"], "n_lines", "n_dropped"]
        assert {(r.rest, r["a.b"], r.h2) for r in got.collect()} == {(7, 7, 7)}
