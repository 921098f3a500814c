import io
import math
import time

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from phasewell import cli
from phasewell.functions import identity, kernel
from phasewell.operators import patterns, query, routing
from phasewell.operators.store import Store
from phasewell.plans import registry
from phasewell.schema import PATTERN_SCHEMA, CorpusNotFound, CorpusNotReady, DuplicatePattern, InvalidPattern, PatternNotFound, clamp_k
from phasewell.sources import files
from phasewell.streaming import ingest

SF = "/root/testdata/sf0.001"
FIXED = ([0.37454012, 0.9507143, 0.7319939, 0.5986584], [0.9802940, 0.9801420, 0.3649500, 5.4423451])


def const(a, f, n=4):
    return [a] * n, [f] * n


def frame(spark, pats):
    return spark.createDataFrame([(*p, {"n": str(i)}) for i, p in enumerate(pats)], "amplitude array<double>, phase array<double>, metadata map<string,string>")


@pytest.mark.parametrize(("a", "b", "energy", "delta", "zone"), [((1, 0), (1, 0), 1.0, 0.0, "CORE"), ((1, 0), (1, 0.2), 0.99003327, 0.2, "CORE"), ((1, 0), (1, 0.5), 0.9387913, 0.5, "FRINGE"), ((1, 0), (0.65, 0), 0.874534, 0.0, "CORE"), ((1, 0.3), (0.2, 0.9), 0.25335324, 0.6, "SHADOW"), ((1, 0), (1, math.pi), 0.0, None, "SHADOW"), ((0, 0), (0, 1), 0.0, None, "SHADOW")])
def test_golden_kernels(spark, a, b, energy, delta, zone):
    df = spark.createDataFrame([(*const(*map(float, a)), *const(*map(float, b)))], "aa array<double>, ap array<double>, ba array<double>, bp array<double>")
    e, d = kernel.compare(F.col("aa"), F.col("ap"), F.col("ba"), F.col("bp")), kernel.phase_delta(F.col("ap"), F.col("bp"))
    r = df.select(e.alias("e"), d.alias("d"), kernel.zone(e, d).alias("z")).first()
    assert abs(r.e - energy) < 1e-6 and r.z == zone and (delta is None or abs(r.d - delta) < 1e-6)


def test_numpy_twin_symmetry_and_bounds(spark):
    rng = np.random.default_rng(0)
    a, p = rng.uniform(0, 1, (20, 37)), rng.uniform(0, 6, (20, 37))
    df = spark.createDataFrame([(a[i].tolist(), p[i].tolist()) for i in range(20)], "amplitude array<double>, phase array<double>")
    s = kernel.score_udf(a[3].tolist(), p[3].tolist())("amplitude", "phase")
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    for r in df.select(s.alias("s"), kernel.compare(lit(a[3]), lit(p[3]), F.col("amplitude"), F.col("phase")).alias("e"), kernel.compare(F.col("amplitude"), F.col("phase"), lit(a[3]), lit(p[3])).alias("e2"), kernel.phase_delta(lit(p[3]), F.col("phase")).alias("d")).collect():
        assert abs(r.s.energy - r.e) < 1e-9 and abs(r.e - r.e2) < 1e-9 and abs(r.s.phase_delta - r.d) < 1e-9 and -1e-9 <= r.e <= 1 + 1e-9


def test_identity(spark):
    assert identity.content_id_of(*FIXED) == "45ffdaa3cf70bf67d4814e63c20bed05"
    assert identity.content_id_of(*const(1.0, 0.0)) == "4ab22d0b8c0816554f8f26cc956503d2"
    assert identity.content_id_of(*const(0.7, 0.3, 1536)) == "c2dea8beb84ea1590201d34843c50d8e"
    assert frame(spark, [FIXED]).select(identity.content_id("amplitude", "phase")).first()[0] == identity.content_id_of(*FIXED)
    assert identity.checksum(b"abc", 4) == 0x352441C2
    assert identity.checksum(b"", 8) == xxhash.xxh64(b"", 0x9747B28C).intdigest()
    with pytest.raises(ValueError):
        identity.checksum(b"", 3)


def test_zone_first_order(spark):
    table = spark.createDataFrame([("a", *const(1.0, 0.5)), ("b", *const(0.65, 0.0))], "id string, amplitude array<double>, phase array<double>")
    psi = spark.createDataFrame([("q", *const(1.0, 0.0))], "id string, amplitude array<double>, phase array<double>")
    assert [r.id for r in query.query(table, psi, 2).collect()] == ["a", "b"]
    assert [r.id for r in query.query_detailed(table, psi, 2).collect()] == ["b", "a"]
    assert query.query(table, psi, 0).count() == 0
    other = spark.createDataFrame([("c", *const(1.0, 0.0, 5))], table.schema)
    assert query.query(table.unionByName(other), psi, 9).count() == 2


def test_weights_and_limits():
    assert patterns.weights_for(2, None) == patterns.weights_for(2, []) == [1.0, 1.0]
    with pytest.raises(ValueError):
        patterns.weights_for(2, [1.0])
    assert (clamp_k(None), clamp_k(-3), clamp_k(10**6)) == (10, 0, 10_000)


def test_buckets_clamp_and_wrap(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (-9.0, -math.pi, 0.0, math.pi, 9.0)], "x double").select(routing.bucket(F.col("x"))).collect()]
    assert got == [0, 0, 32, 63, 63]
    d = spark.range(1).select(routing.circular_distance(F.lit(3.1), F.lit(-3.1))).first()[0]
    assert abs(d - (2 * math.pi - 6.2)) < 1e-9


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.query("c", *const(1.0, 0.0)).count() == 0
    with pytest.raises(CorpusNotFound):
        s.delete("c", ["0" * 32])
    pats = [const(1.0, 0.2 * i) for i in range(10)]
    assert s.insert("c", frame(spark, pats)) == 10 and s.corpora() == ["c"] and s.info("c")["count"] == 10
    with pytest.raises(DuplicatePattern):
        s.insert("c", frame(spark, [pats[2], const(1.0, 5.5)]))
    with pytest.raises(InvalidPattern):
        s.insert("c", frame(spark, [const(1.0, 0.0, 5)]))
    assert s.insert("c", frame(spark, [pats[2], const(1.0, 5.5)]), on_duplicate="skip") == 1
    hits = s.query("c", *pats[3], k=5).collect()
    ids = [identity.content_id_of(*p) for p in pats]
    assert hits[0].id == ids[3] and abs(hits[0].energy - 1) < 1e-5 and [h.energy for h in hits] == sorted((h.energy for h in hits), reverse=True)
    assert [h.id for h in s.query("c", *pats[3], k=1, mode="routed").collect()] == [ids[3]]
    assert s.query_composite("c", [pats[0], pats[2]], [0.6, 0.4], 3, detailed=True).count() == 3
    s.delete("c", [ids[0]])
    assert not s.contains("c", *pats[0]) and s.contains("c", *pats[1])
    with pytest.raises(PatternNotFound):
        s.delete("c", [ids[0]])
    with pytest.raises(DuplicatePattern):
        s.replace("c", ids[1], *pats[4])
    assert s.replace("c", ids[1], *pats[1]) == ids[1] and s.get("c", ids[1]).first().metadata == {"n": "1"}
    new = s.replace("c", ids[1], *const(2.0, 0.1), {"x": "y"})
    assert s.get("c", new).first().metadata == {"x": "y"} and not s.contains("c", *pats[1])
    assert s.compact("c") >= 1 and s.table("c").count() == 10


def test_store_writes_batches_only(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.insert("c", frame(spark, [const(1.0, 0.01 * i) for i in range(50)]))
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    ids = [r.id for r in s.table("c").select("id").collect()]
    s.insert("c", frame(spark, [const(1.0, 3.0)]))
    s.delete("c", ids[:2])
    assert all(f.stat().st_mtime_ns == t for f, t in before.items())
    segments = s.info("c")["segments"]
    assert [x["rows"] for x in segments] == [50, 1, 2] and s.table("c").count() == s.info("c")["count"] == 49
    assert s.compact_if_thin("c") == 0
    s.insert("c", frame(spark, [const(1.0, 4.0)]))
    assert s.compact_if_thin("c") == 4 and len(s.info("c")["segments"]) == 1 and s.table("c").count() == 50
    assert s.insert("c", frame(spark, [const(1.0, 0.01 * i) for i in range(50)]), on_duplicate="skip") == 2  # the deleted ones come back


def test_store_survives_a_crash(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path))
    s.insert("c", frame(spark, [const(1.0, 0.1)]))
    old = s.info("c")
    monkeypatch.setattr(files, "write_state", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        s.insert("c", frame(spark, [const(1.0, 0.2)]))  # its segment is written, its state isn't
    monkeypatch.undo()
    assert s.info("c") == old and s.table("c").count() == 1
    assert s.insert("c", frame(spark, [const(1.0, 0.3)])) == 1 and s.table("c").count() == 2
    with pytest.raises(OSError, match="another writer"):
        files.write_state(spark, f"{tmp_path}/c", old | {"version": s.info("c")["version"]})
    (tmp_path / "c" / ".half.tmp").write_text("{")
    assert s.info("c")["count"] == 2
    for f in (tmp_path / "c").glob("state-*.json"):
        f.unlink()
    assert not s.exists("c") and s.recover("c")["pattern_len"] == 4 and s.table("c").count() >= 2
    with pytest.raises(CorpusNotFound):
        s.recover("none")


def test_states_and_metadata(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.insert("c", frame(spark, [const(1.0, 0.1), const(1.0, 0.2)]))
    i = identity.content_id_of(*const(1.0, 0.1))
    assert s.metadata("c", i) == {"n": "0"} and s.contains_metadata("c", i)
    s.put_metadata("c", i, {"a": "b"})
    assert s.metadata("c", i.upper()) == {"a": "b"} and s.table("c").count() == 2
    s.remove_metadata("c", i)
    assert not s.contains_metadata("c", i) and s.metadata_table("c").count() == 1
    with pytest.raises(PatternNotFound):
        s.metadata("c", "0" * 32)
    s.set_state("c", "READ_ONLY")
    for change in (lambda: s.insert("c", frame(spark, [const(1.0, 0.9)])), lambda: s.delete("c", [i]), lambda: s.compact("c")):
        with pytest.raises(CorpusNotReady):
            change()
    assert s.query("c", *const(1.0, 0.1)).count() == 2
    s.set_state("c", "BROKEN")
    with pytest.raises(CorpusNotReady):
        s.query("c", *const(1.0, 0.1))
    with pytest.raises(ValueError):
        s.set_state("c", "GONE")


def test_compare_interference_and_wild_numbers(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.compare(*const(1.0, 0.0), *const(1.0, 0.2)) == pytest.approx(0.99003327, abs=1e-6)
    assert s.compare(*const(1.0, 0.0), *const(1.0, 0.2), ignore_phase=True) == 1.0
    for bad in ((*const(1.0, 0.0), *const(1.0, 0.0, 5)), ([1.0], [1.0, 2.0], [1.0], [1.0]), ([], [], [], []), (None, [1.0], [1.0], [1.0])):
        with pytest.raises(InvalidPattern):
            s.compare(*bad)
    with pytest.raises(InvalidPattern):
        s.insert("c", frame(spark, [([1.0, float("nan")], [0.0, 0.0])]))
    s.insert("c", frame(spark, [const(1.0, 0.1 * i) for i in range(5)]))
    one = s.query_interference("c", *const(1.0, 0.0), 3).first()
    assert len(one.matches) == 3 and [m.zone for m in one.matches] == ["CORE"] * 3
    assert s.query_interference_map("c", *const(1.0, 0.0), 3).columns == ["id", "energy", "phase_shift", "zone"]
    with pytest.raises(InvalidPattern):
        s.query_interference("c", *const(1.0, 0.0, 3))


def test_nan_ranks_last_and_ids_once(spark):
    rows = [("a", *const(1.0, 0.4)), ("a", *const(1.0, 0.4)), ("b", *const(1.0, 0.5)), ("n", [float("nan")] * 4, [0.0] * 4)]
    table = spark.createDataFrame(rows, "id string, amplitude array<double>, phase array<double>")
    psi = spark.createDataFrame([("q", *const(1.0, 0.0))], table.schema)
    assert [r.id for r in query.query(table, psi, 9).collect()] == ["a", "a", "b", "n"]
    assert [r.id for r in query.query(table, psi, 9, distinct=True).collect()] == ["a", "b", "n"]
    assert dict(query.query(table, psi, 9).dtypes)["energy"] == "float"
    assert [(r.id, r["rank"]) for r in query.query_batch(table.where("id != 'n'").dropDuplicates(["id"]), psi, 5).orderBy("rank").collect()] == [("a", 1), ("b", 2)]


def test_fold_is_linear_in_the_length(spark):
    def seconds(length, rows):
        df = spark.range(rows).select(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda x: (x * 7 % 13).cast("double") - 6).alias("embedding"))
        folded = patterns.fold(df).select("amplitude", "phase", "energy_total")
        took = []
        for _ in range(3):
            began = time.perf_counter()
            folded.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    seconds(8, 100)
    assert seconds(3072, 2000) < 3 * seconds(192, 32_000) + 1  # the same number of components
    odd = spark.createDataFrame([([3.0, 4.0, 9.0],), (None,), ([],)], "embedding array<float>")
    assert [(r.amplitude, r.energy_total) for r in patterns.fold(odd).collect()] == [([5.0], 25.0), (None, None), ([], 0.0)]


def test_sources(spark, tmp_path):
    pats = spark.createDataFrame([("a", [1.0], [0.5], {"x": "y"}), ("b", [2.0], [0.1], None)], PATTERN_SCHEMA)
    for form in ("parquet", "orc", "json"):
        files.write_patterns(pats, f"{tmp_path}/{form}", form)
        assert sorted(map(tuple, files.read_patterns(spark, f"{tmp_path}/{form}", form).select("id", "amplitude", "phase").collect())) == [("a", [1.0], [0.5]), ("b", [2.0], [0.1])]
    with pytest.raises(ValueError):
        files.read_patterns(spark, str(tmp_path), "csv")
    matches = spark.createDataFrame([("a", 0.5, 0.25, "CORE", 2.0)], "id string, energy float, phase_delta double, zone string, zone_score double")
    files.write_tsv(matches, f"{tmp_path}/tsv")
    assert [r.value for r in spark.read.text(f"{tmp_path}/tsv").collect()] == ["a\t0.50000000\t0.25000000\tCORE\t2.0000"]


def test_cli(spark, tmp_path, capsys, monkeypatch):
    root, amp, phase = str(tmp_path), "1,1,1", "0.1,0.2,0.3"
    assert cli.main([root, "insert", amp, phase, "--meta", "a:b"]) == 0 and cli.main([root, "insert", amp, "0.2,0.3,0.4"]) == 0
    assert cli.main([root, "insert", amp, phase]) == 1 and cli.main([root, "query", "1,1", "0,0"]) == 1 and cli.main([root, "nothing"]) == 1 and cli.main([root]) == 1
    capsys.readouterr()
    assert cli.main([root, "info"]) == 0 and capsys.readouterr().out == "default\t3\t2\tACTIVE\n"
    assert cli.main([root, "compare", "1,1", "0,0", "1,1", "0,0"]) == 0 and capsys.readouterr().out == "1.00000000\n"
    first = identity.content_id_of([1.0] * 3, [0.1, 0.2, 0.3])
    for command, columns in (("query", 2), ("querydetailed", 5), ("interferencemap", 4)):
        assert cli.main([root, command, amp, phase, "-k", "1"]) == 0
        out = capsys.readouterr().out.strip().split("\t")
        assert out[0] == first and len(out) == columns
    assert cli.main([root, "interference", amp, phase]) == 0 and capsys.readouterr().out.count("\n") == 3
    assert cli.main([root, "compositedetailed", f"{amp}|{phase}; {amp}|{phase}", "--weights", "0.5,0.5", "-k", "2"]) == 0 and capsys.readouterr().out.count("\n") == 2
    monkeypatch.setattr("sys.stdin", io.StringIO(f"info\nbad\ndelete {first}\nexit\ninfo\n"))
    assert cli.main([root, "repl"]) == 0 and capsys.readouterr().out.count("\n") == 1
    assert cli.main([root, "replace", identity.content_id_of([1.0] * 3, [0.2, 0.3, 0.4]), amp, phase]) == 0 and capsys.readouterr().out.strip() == first
    assert cli.main(["help"]) == 0 and "interferencemap" in capsys.readouterr().out


def test_streaming_ingest(spark, tmp_path):
    frame(spark, [const(1.0, 0.1 * i) for i in range(5)] * 2).write.parquet(f"{tmp_path}/in")
    s = Store(spark, f"{tmp_path}/store")
    stream = spark.readStream.schema("amplitude array<double>, phase array<double>, metadata map<string,string>").parquet(f"{tmp_path}/in")
    ingest.ingest(stream, s, "live", f"{tmp_path}/ck", once=True).awaitTermination(120)
    assert s.info("live")["count"] == 5


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cur = con.execute(registry.ORACLE[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plan_prunes_and_ranks(spark):
    plan = registry.QUERIES["query_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan
    routed = registry.QUERIES["phase_bucket"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in routed
