"""Line dedup over levelled sorted runs of line hashes.

A run is a bucketed and sorted Parquet table of (h1, h2, n): 128-bit line hashes with the number of documents that hold
the line. All runs of a folder have the same buckets, so they meet each other by merge joins without a shuffle. Each
batch of documents adds one run at level 0: its own counts, merge-anti-joined with each run's lines that are common
already, whose further counts would change nothing. When FANOUT runs stand at a level they are merged into one of the
next (a full outer merge join that adds counts). A run's name tells its level, the batches it covers and its buckets,
so a merge that was cut short leaves nothing that counts twice. Finally lines whose count over all runs reaches the
limit are dropped from every document: by a broadcast of their hashes while there are at most BROADCAST_KEYS, else by
joining line hashes with them and each document's dropped positions with the document.

Edge cases. A null or empty text is one empty line; blank lines are never common. A document is a row,
whatever its id, and counts a line once. Repeated rows are documents of their own. An empty table gives an
empty result. Whole texts are read; other columns are kept, but for ones named n_lines or n_dropped, which the
counts replace.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, as_bytes, delete, hadoop, tasks_for

#: Parameters: documents that make a line common; runs of a level before they merge; batches that a
#: whole table is dealt into (by source partition); lines in a bucket of a run; keys (16 bytes, some 100 in a worker's
#: set) up to which the common lines are broadcast; lines a task counts before it passes them on; salts of the join
#: beyond the broadcast.
MIN_DOCS = 10
FANOUT = 2
BATCHES = 3
BUCKET_ROWS = 2_000_000
BROADCAST_KEYS = 250_000
COUNTED = 400_000
SALTS = 16

BLANK = b" \t\n\x0b\f\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def line_key(line: bytes) -> bytes:
    """16 bytes that stand for the line stripped and lower-cased; empty for a blank line."""
    key = line.strip(BLANK)
    return xxhash.xxh3_128_digest(key.translate(LOWER)) if key else b""


def keys_of(text: bytes | None) -> list[bytes]:
    return [line_key(x) for x in (text or b"").split(b"\n")]


def as_longs(keys: list[bytes]) -> tuple[pa.Array, pa.Array]:
    pair = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))


def line_counts(texts: DataFrame, batches: int = 1) -> DataFrame:
    """(batch, h1, h2, n) of the first column's lines: documents that hold each, summed within a task.

    A source partition belongs to one batch.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        batch = TaskContext.get().partitionId() % batches

        def emit() -> Iterator[pa.RecordBatch]:
            if counts:
                h1, h2 = as_longs(list(counts))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), batch, np.int32)), h1, h2, pa.array(list(counts.values()), pa.int64())], names=["batch", "h1", "h2", "n"])
                counts.clear()

        for b in parts:
            for text in as_bytes(b.column(0)):
                keys = set(keys_of(text))
                keys.discard(b"")
                for k in keys:
                    counts[k] = counts.get(k, 0) + 1
            if len(counts) > COUNTED:
                yield from emit()
        yield from emit()

    return texts.mapInArrow(run, "batch int, h1 long, h2 long, n long")


class LineRuns:
    """The levelled runs in one folder; they can be reopened and extended by later batches."""

    SCHEMA = "h1 BIGINT, h2 BIGINT, n BIGINT"
    KEY = ["h1", "h2"]

    def __init__(self, spark, path: str, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.path, self.min_docs, self.fanout = spark, path, min_docs, fanout
        self.buckets = next((r[3] for r in self.runs()), buckets or tasks_for(spark, 0, 1))

    def runs(self) -> list[tuple[int, int, int, int]]:
        """(level, first batch, last batch, buckets) of each complete run that no merged run covers."""
        fs, p = hadoop(self.spark, self.path)
        found = []
        for s in fs.listStatus(p) if fs.exists(p) else ():
            m = re.fullmatch(r"run-(\d+)-(\d+)-(\d+)-(\d+)", s.getPath().getName())
            if m and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                found.append(tuple(map(int, m.groups())))
        return sorted(r for r in found if not any(o != r and o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in found))

    def name(self, run) -> str:
        return f"{self.path}/run-{'-'.join(map(str, run))}"

    def table(self, run) -> str:
        """The name under which the session's catalog knows a run's files; whoever opens a folder names its runs anew."""
        return f"line_run_{hashlib.md5(self.name(run).encode()).hexdigest()}"

    def read(self, run) -> DataFrame:
        name, place = self.table(run), self.name(run).replace("'", "\\'")
        if not self.spark.catalog.tableExists(name):
            key = ", ".join(self.KEY)
            self.spark.sql(f"CREATE TABLE {name} ({self.SCHEMA}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {run[3]} BUCKETS LOCATION '{place}'")
        return self.spark.table(name)

    def write(self, df: DataFrame, run) -> None:
        """df is dealt by the key into as many partitions as a run has buckets, so each task writes one sorted file."""
        df.write.bucketBy(self.buckets, *self.KEY).sortBy(*self.KEY).option("path", self.name(run)).mode("overwrite").saveAsTable(self.table(run))

    def remove(self, run) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table(run)}")
        delete(self.spark, self.name(run))

    def merged(self, runs) -> DataFrame:
        """Several runs as one: merge joins of sorted, equally bucketed tables that add the counts."""
        sum_of = lambda a, b: F.coalesce(a["n"], F.lit(0)) + F.coalesce(b["n"], F.lit(0))
        both = lambda a, b: a.hint("merge").join(b.hint("merge"), (a["h1"] == b["h1"]) & (a["h2"] == b["h2"]), "full").select(*[F.coalesce(a[c], b[c]).alias(c) for c in self.KEY], sum_of(a, b).alias("n"))
        return reduce(both, map(self.read, runs)) if runs else self.spark.createDataFrame([], self.SCHEMA)

    def common(self) -> DataFrame:
        """(h1, h2) of the lines whose count over all runs has reached the limit."""
        return self.merged(self.runs()).where(F.col("n") >= self.min_docs).select(*self.KEY)

    def fresh(self, counts: DataFrame) -> DataFrame:
        """A batch's counts, (h1, h2, n) rows of any number a line, less lines that one of the runs knows as common."""
        new = counts.select("h1", "h2", "n").repartition(self.buckets, *self.KEY).groupBy(*self.KEY).agg(F.sum("n").alias("n"))
        known = [self.read(r).where(F.col("n") >= self.min_docs).select(*self.KEY) for r in self.runs()]
        return reduce(lambda left, right: left.hint("merge").join(right.hint("merge"), self.KEY, "left_anti"), known, new)

    def add(self, counts: DataFrame) -> None:
        """One batch."""
        batch = 1 + max((r[2] for r in self.runs()), default=-1)
        self.write(self.fresh(counts), (0, batch, batch, self.buckets))
        self.merge()

    def merge(self) -> None:
        level = 0
        while level <= max((r[0] for r in self.runs()), default=-1):
            at = [r for r in self.runs() if r[0] == level]
            if len(at) >= self.fanout:
                self.write(self.merged(at), (level + 1, at[0][1], at[-1][2], self.buckets))
                for r in at:
                    self.remove(r)
            level += 1

    def close(self) -> None:
        """Forgets the runs' names; their files stay."""
        for r in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table(r)}")


def common_lines(work: Work, df: DataFrame, text_col: str, min_docs: int) -> DataFrame:
    """(h1, h2) of lines that stand in at least min_docs rows of df."""
    counts = line_counts(df.select(F.col(f"`{text_col}`").cast("string")), BATCHES)
    path = work.path("counts")
    counts.write.partitionBy("batch").parquet(path)
    dealt = work.spark.read.schema("h1 long, h2 long, n long, batch int").parquet(path)
    runs = LineRuns(work.spark, work.path("runs"), min_docs, buckets=tasks_for(work.spark, dealt.count(), BUCKET_ROWS))
    for k in range(BATCHES):
        runs.add(dealt.where(F.col("batch") == k))
    hot = work.save(runs.common(), "hot")
    runs.close()
    for done in ("counts", "runs"):
        work.drop(done)
    return hot


def kept_text(text: bytes | None, dropped: set[int]) -> str:
    lines = (text or b"").split(b"\n")
    return b"\n".join(x for i, x in enumerate(lines) if i not in dropped).decode()


def drop_common_lines(df: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """df's columns (texts less common lines), then n_lines and n_dropped, the numbers of lines before and dropped."""
    spark = df.sparkSession
    work = Work(spark, "lines")
    hot = common_lines(work, df, text_col, min_docs)
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("n_lines", "n_dropped")])
    rest = [c for c in df.columns if c != text_col]
    struct = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.lit(0).alias("pad"))
    body = df.select(struct.alias("rest"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if hot.count() <= broadcast_keys:
        keys = hot.toArrow()
        pairs = np.column_stack([keys["h1"].to_numpy(), keys["h2"].to_numpy()]).astype(np.int64)
        shared = spark.sparkContext.broadcast(pairs.tobytes())  # at most 16 * broadcast_keys bytes
        held = {}

        def clean(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            raw = shared.value
            common = held.setdefault("common", {raw[i : i + 16] for i in range(0, len(raw), 16)})
            for b in parts:
                texts = as_bytes(b.column(1))
                drops = [{i for i, k in enumerate(keys_of(t)) if k in common} for t in texts]
                yield from cleaned(b.column(0), texts, drops)

        out = body.mapInArrow(clean, out_schema(body))
    else:
        rows = work.save(body.withColumn("row", F.monotonically_increasing_id()), "rows")
        lines = rows.select("text", "row").mapInArrow(positions, "row long, at int, h1 long, h2 long")
        salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = lines.withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS))).join(salted, ["h1", "h2", "salt"])
        drops = work.save(met.groupBy("row").agg(F.collect_list("at").alias("drop")), "drops")  # positions of one text

        def clean(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                yield from cleaned(b.column(0), as_bytes(b.column(1)), [set(x or ()) for x in b.column(2).to_pylist()])

        out = rows.join(drops, "row", "left").select("rest", "text", "drop").mapInArrow(clean, out_schema(body))
    columns = [F.col("text").alias(c) if c == text_col else F.col("rest")[f"c{rest.index(c)}"].alias(c) for c in df.columns]
    return out.select(*columns, "n_lines", "n_dropped")


def out_schema(body: DataFrame):
    return body.selectExpr("rest", "text", "0L AS n_lines", "0L AS n_dropped").schema


def positions(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        row, at, keys = [], [], []
        for t, r in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
            found = [(i, k) for i, k in enumerate(keys_of(t)) if k]
            row += [r] * len(found)
            at += [i for i, _ in found]
            keys += [k for _, k in found]
        h1, h2 = as_longs(keys)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(at, pa.int32()), h1, h2], names=["row", "at", "h1", "h2"])


def cleaned(rest, texts, drops) -> Iterator[pa.RecordBatch]:
    if len(texts):
        kept = pa.array([kept_text(t, d) for t, d in zip(texts, drops, strict=True)], pa.string())
        n = pa.array([(t or b"").count(b"\n") + 1 for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([rest, kept, n, pa.array([len(d) for d in drops], pa.int64())], names=["rest", "text", "n_lines", "n_dropped"])


def oracle() -> str:
    """The contract's rows as DuckDB SQL over documents."""
    key = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, {key} AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= {MIN_DOCS})
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY i) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY r"""
