"""Corpora of patterns as immutable segments listed by a versioned state file.

Layout: root/<corpus>/state-<n>.json (length, state, times, version, segments) and root/<corpus>/<segment>/ as Parquet. A
segment holds either rows, partitioned by phase bucket and sorted by id within files of bounded size, or tombstones
(ids). A mutation writes segments of the batch's size only and then adds the next state file; a failed one leaves the
old state, and files that no state names. A row is live unless a tombstone of a later version names its id. Many
thin segments are merged by fill (compact_if_thin). One writer a corpus at a time: a second one fails on its state file.

Batches are joined on the id; nothing is collected but counts (one a phase bucket at most) and at most ten offending ids
for an error. Components that aren't finite are refused.
"""

from __future__ import annotations

import re
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasewell.functions import identity, kernel
from phasewell.operators import patterns, query, routing
from phasewell.schema import CONFIG, STATES, STORED_SCHEMA, Config, CorpusNotFound, CorpusNotReady, DuplicatePattern, InvalidPattern, PatternNotFound
from phasewell.sources import files

COLUMNS = [c.split()[0] for c in STORED_SCHEMA.split(", ")]
#: Parameter: tombstones up to which they are broadcast (16 bytes of id text and a number each).
FEW = 200_000


def latest(versions: DataFrame, id_col: str = "id", version_col: str = "version", deleted_col: str | None = None) -> DataFrame:
    """The last version of each id, less deleted ones."""
    newest = versions.withColumn("_rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(version_col).desc()))).where("_rank = 1").drop("_rank")
    return newest if deleted_col is None else newest.where(~F.col(deleted_col))


def insert_batch(current: DataFrame, batch: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows of the batch new to current, once each; ids that current or the batch has already."""
    once = batch.dropDuplicates([id_col])
    accepted = once.join(current.select(id_col), id_col, "left_anti")
    return accepted, once.join(current.select(id_col), id_col, "left_semi")


def delete_batch(current: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return current.join(ids.select(id_col), id_col, "left_anti")


def replace_batch(current: DataFrame, changes: DataFrame, id_col: str = "id", old_col: str = "old_id") -> DataFrame:
    """current less the old ids, plus the changes' rows."""
    return delete_batch(current, changes.select(F.col(old_col).alias(id_col)), id_col).unionByName(changes.drop(old_col))


def live(rows: DataFrame, dead: DataFrame | None, few: bool = True) -> DataFrame:
    """rows (with version) less those that a tombstone (id, version) of a later version names."""
    if dead is None:
        return rows
    last = dead.groupBy("id").agg(F.max("version").alias("_gone"))
    met = rows.join(F.broadcast(last) if few else last, "id", "left")
    return met.where("_gone IS NULL OR _gone <= version").drop("_gone")


class Store:
    """All corpora under one root."""

    def __init__(self, spark: SparkSession, root: str, config: Config = CONFIG):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config

    # --- corpora ---

    def _folder(self, corpus: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9._-]{1,128}", corpus.strip()) or set(corpus.strip()) == {"."}:
            raise ValueError(f"bad corpus id {corpus!r}")
        return f"{self.root}/{corpus.strip()}"

    def corpora(self) -> list[str]:
        return [c for c in files.names(self.spark, self.root) if files.versions(self.spark, f"{self.root}/{c}")]

    def info(self, corpus: str) -> dict:
        state = files.read_state(self.spark, self._folder(corpus))
        if state is None:
            raise CorpusNotFound(corpus)
        return state

    def exists(self, corpus: str) -> bool:
        return bool(files.versions(self.spark, self._folder(corpus)))

    def set_state(self, corpus: str, state: str) -> None:
        if state not in STATES:
            raise ValueError(state)
        now = self.info(corpus)
        files.write_state(self.spark, self._folder(corpus), now | {"state": state, "version": now["version"] + 1})

    def _writable(self, corpus: str) -> dict:
        state = self.info(corpus)
        if state["state"] != "ACTIVE":
            raise CorpusNotReady(f"{corpus} is {state['state']}")
        return state

    def recover(self, corpus: str) -> dict:
        """Makes a state for a folder that has complete segments but no state file; raises CorpusNotFound without any."""
        if self.exists(corpus):
            return self.info(corpus)
        folder, found = self._folder(corpus), []
        for name in files.names(self.spark, folder):
            m = re.fullmatch(r"(rows|dead)-(\d+)-[0-9a-f]{8}", name)
            if m and files.exists(self.spark, f"{folder}/{name}/_SUCCESS"):
                found.append({"name": name, "kind": m[1], "version": int(m[2]), "rows": self.spark.read.parquet(f"{folder}/{name}").count()})
        if not any(s["kind"] == "rows" for s in found):
            raise CorpusNotFound(corpus)
        now, last = time.time(), max(s["version"] for s in found)
        state = {"id": corpus, "pattern_len": 0, "state": "ACTIVE", "created": now, "updated": now, "version": last, "count": 0, "segments": found}
        one = self._read(corpus, state)
        state |= {"count": one.count(), "pattern_len": (one.select(F.max("pattern_len")).first()[0] or self.config.pattern_len)}
        files.write_state(self.spark, folder, state)
        return state

    def _read(self, corpus: str, state: dict) -> DataFrame:
        folder = self._folder(corpus)

        def of(kind: str, schema: str) -> DataFrame | None:
            parts = [self.spark.read.schema(schema).parquet(f"{folder}/{s['name']}").withColumn("version", F.lit(s["version"])) for s in state["segments"] if s["kind"] == kind]
            return reduce(DataFrame.unionByName, parts) if parts else None

        rows, dead = of("rows", STORED_SCHEMA), of("dead", "id string")
        if rows is None:
            return self.spark.createDataFrame([], STORED_SCHEMA)
        few = sum(s["rows"] for s in state["segments"] if s["kind"] == "dead") <= FEW
        return live(rows, dead, few).select(*COLUMNS)

    def table(self, corpus: str) -> DataFrame:
        """Live rows; empty for a corpus that doesn't exist."""
        if not self.exists(corpus):
            return self.spark.createDataFrame([], STORED_SCHEMA)
        state = self.info(corpus)
        if state["state"] in ("BROKEN", "DELETING"):
            raise CorpusNotReady(f"{corpus} is {state['state']}")
        return self._read(corpus, state)

    def _segment(self, corpus: str, version: int, kind: str, rows: DataFrame) -> dict:
        """Writes one segment under a name of its own; never over another."""
        name = f"{kind}-{version}-{uuid.uuid4().hex[:8]}"
        path = f"{self._folder(corpus)}/{name}"
        if kind == "dead":
            rows.select("id").write.parquet(path)
        else:
            sizes = {r.phase_bucket: r["count"] for r in rows.groupBy("phase_bucket").count().collect()}  # at most one row a bucket
            files_of = F.coalesce(*[F.when(F.col("phase_bucket") == b, F.lit(-(-n // self.config.file_rows))) for b, n in sizes.items()], F.lit(1))
            slot = F.pmod(F.xxhash64("id"), files_of)  # a hot bucket, such as the clamped ends, is split
            dealt = rows.select(*COLUMNS).repartition(max(1, sum(-(-n // self.config.file_rows) for n in sizes.values())), "phase_bucket", slot)
            dealt.sortWithinPartitions("phase_bucket", "id").write.partitionBy("phase_bucket").parquet(path)
        return {"name": name, "kind": kind, "version": version, "rows": self.spark.read.parquet(path).count()}

    def _publish(self, corpus: str, state: dict, rows: DataFrame | None = None, dead: DataFrame | None = None, gone: int = 0) -> dict:
        """The next state: with segments of new rows and of tombstones for rows of earlier versions (gone: how many)."""
        version, added = state["version"] + 1, []
        if dead is not None:
            added.append(self._segment(corpus, version, "dead", dead))
        if rows is not None:
            added.append(self._segment(corpus, version, "rows", rows))
        fresh = sum(s["rows"] for s in added if s["kind"] == "rows")
        state = state | {"version": version, "count": state["count"] + fresh - gone, "updated": time.time(), "segments": state["segments"] + [s for s in added if s["rows"]]}
        files.write_state(self.spark, self._folder(corpus), state)
        return state

    # --- batches ---

    def prepare(self, corpus: str, batch: DataFrame) -> tuple[DataFrame, int]:
        """Stored rows of a batch (amplitude, phase, metadata) and their length; raises InvalidPattern."""
        known = self.info(corpus)["pattern_len"] if self.exists(corpus) else None
        wild = lambda c: F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        bad = F.col("amplitude").isNull() | F.col("phase").isNull() | (F.size("amplitude") != F.size("phase")) | (F.size("amplitude") < 1) | wild("amplitude") | wild("phase")
        got = batch.agg(F.count_if(bad).alias("bad"), F.min(F.size("amplitude")).alias("lo"), F.max(F.size("amplitude")).alias("hi")).first()
        if got.bad or (got.hi is not None and (got.lo != got.hi or got.hi > self.config.longest or known not in (None, got.hi))):
            raise InvalidPattern(f"{got.bad} malformed patterns, lengths {got.lo} to {got.hi}, corpus length {known}")
        meta = F.col("metadata") if "metadata" in batch.columns else F.lit(None)
        rows = routing.placed(batch.withColumn("metadata", F.coalesce(meta.cast("map<string,string>"), F.create_map().cast("map<string,string>"))), self.config)
        rows = rows.withColumn("id", identity.content_id("amplitude", "phase")).withColumn("corpus_id", F.lit(corpus)).withColumn("pattern_len", F.size("amplitude")).withColumn("energy_total", kernel.energy_total(F.col("amplitude")))
        return rows, known or got.hi or self.config.pattern_len

    def insert(self, corpus: str, batch: DataFrame, on_duplicate: str = "error") -> int:
        """Adds a batch, creating the corpus at its first; on_duplicate: error (nothing is added) or skip (of equal rows
        of the batch the one whose metadata come first stays). Writes the batch only. Returns rows added."""
        state = self._writable(corpus) if self.exists(corpus) else None
        prepared, length = self.prepare(corpus, batch)
        staged = f"{self._folder(corpus)}/.staged-{uuid.uuid4().hex}"
        try:
            prepared.select(*COLUMNS).write.parquet(staged)  # ids are worked out once
            rows, current = self.spark.read.schema(STORED_SCHEMA).parquet(staged), self.table(corpus).select("id")
            first = F.row_number().over(Window.partitionBy("id").orderBy(F.to_json("metadata")))
            if on_duplicate == "error":
                repeated = rows.groupBy("id").count().where("count > 1").select("id").unionByName(rows.join(current, "id", "left_semi").select("id"))
                found = [r.id for r in repeated.limit(10).collect()]
                if found:
                    raise DuplicatePattern(", ".join(found))
                accepted = rows
            else:
                accepted = rows.withColumn("_first", first).where("_first = 1").drop("_first").join(current, "id", "left_anti")
            if state is None:
                now = time.time()
                state = {"id": corpus, "pattern_len": length, "state": "ACTIVE", "created": now, "updated": now, "version": 0, "count": 0, "segments": []}
            return self._publish(corpus, state, accepted)["count"] - state["count"]
        finally:
            files.remove(self.spark, staged)

    def delete(self, corpus: str, ids: list[str]) -> None:
        """Removes a bounded list of ids; an unknown one is an error and nothing is removed. Writes tombstones only."""
        state = self._writable(corpus)
        wanted = self._known(corpus, ids)
        self._publish(corpus, state, dead=wanted, gone=len({i.lower() for i in ids}))

    def _known(self, corpus: str, ids: list[str]) -> DataFrame:
        for i in ids:
            if not re.fullmatch("[0-9a-fA-F]{32}", i):
                raise ValueError(f"bad id {i!r}")
        wanted = self.spark.createDataFrame([(i.lower(),) for i in ids], "id string").distinct()
        missing = [r.id for r in wanted.join(self.table(corpus).select("id"), "id", "left_anti").limit(10).collect()]
        if missing:
            raise PatternNotFound(", ".join(missing))
        return wanted

    def replace(self, corpus: str, old_id: str, amplitude, phase, metadata: dict | None = None) -> str:
        """Swaps one pattern; the same content without metadata keeps the old metadata. Returns the new id."""
        state = self._writable(corpus)
        wanted = self._known(corpus, [old_id])
        rows, _ = self.prepare(corpus, self._one(amplitude, phase, metadata or {}))
        new_id = identity.content_id_of(amplitude, phase)
        if new_id != old_id.lower() and not self.get(corpus, new_id).isEmpty():
            raise DuplicatePattern(new_id)
        if new_id != old_id.lower() or metadata:
            self._publish(corpus, state, rows, wanted, gone=1)
        return new_id

    def _one(self, amplitude, phase, metadata: dict) -> DataFrame:
        return self.spark.createDataFrame([(list(map(float, amplitude)), list(map(float, phase)), metadata)], "amplitude array<double>, phase array<double>, metadata map<string,string>")

    def get(self, corpus: str, pattern_id: str) -> DataFrame:
        """The row of an id; files are sorted by it, so their statistics leave out most of them."""
        return self.table(corpus).where(F.col("id") == pattern_id.lower())

    def contains(self, corpus: str, amplitude, phase) -> bool:
        return not self.get(corpus, identity.content_id_of(amplitude, phase)).isEmpty()

    def compact(self, corpus: str) -> int:
        """Merges all segments into one of the live rows; older ones go. Returns the number dropped."""
        state = self._writable(corpus)
        version = state["version"] + 1
        merged = self._segment(corpus, version, "rows", self.table(corpus))
        files.write_state(self.spark, self._folder(corpus), state | {"version": version, "count": merged["rows"], "segments": [merged] if merged["rows"] else [], "updated": time.time()})
        old = [n for n in files.names(self.spark, self._folder(corpus)) if re.match(r"(rows|dead)-|\.staged-", n) and n != merged["name"]]
        for n in old:
            files.remove(self.spark, f"{self._folder(corpus)}/{n}")
        return len(old)

    def compact_if_thin(self, corpus: str) -> int:
        """compact, if there are more than compact_above segments and their mean fill lies below compact_fill."""
        segments = self.info(corpus)["segments"]
        fill = sum(min(1.0, s["rows"] / self.config.segment_rows) for s in segments) / max(1, len(segments))
        return self.compact(corpus) if len(segments) > self.config.compact_above and fill < self.config.compact_fill else 0

    # --- metadata ---

    def metadata(self, corpus: str, pattern_id: str) -> dict[str, str]:
        row = self.get(corpus, pattern_id).select("metadata").first()
        if row is None:
            raise PatternNotFound(pattern_id)
        return row.metadata

    def put_metadata(self, corpus: str, pattern_id: str, metadata: dict[str, str]) -> None:
        """Replaces a pattern's metadata; an empty dict removes it."""
        state = self._writable(corpus)
        wanted = self._known(corpus, [pattern_id])
        held = self.get(corpus, pattern_id).drop("metadata")
        entries = F.create_map(*[F.lit(x) for pair in metadata.items() for x in pair]).cast("map<string,string>")
        self._publish(corpus, state, held.withColumn("metadata", entries), wanted, gone=1)

    def remove_metadata(self, corpus: str, pattern_id: str) -> None:
        self.put_metadata(corpus, pattern_id, {})

    def contains_metadata(self, corpus: str, pattern_id: str) -> bool:
        return not self.get(corpus, pattern_id).where(F.size("metadata") > 0).isEmpty()

    def metadata_table(self, corpus: str) -> DataFrame:
        """(id, metadata) of all patterns that have metadata."""
        return self.table(corpus).where(F.size("metadata") > 0).select("id", "metadata")

    # --- queries ---

    def pattern(self, corpus: str, amplitude, phase) -> DataFrame:
        """A checked one-row query for a corpus; raises InvalidPattern."""
        length = self.info(corpus)["pattern_len"] if self.exists(corpus) else None
        amplitude, phase = patterns.checked(amplitude, phase, length, self.config)
        return self.spark.createDataFrame([(identity.content_id_of(amplitude, phase), amplitude, phase)], "id string, amplitude array<double>, phase array<double>")

    def compare(self, amplitude_a, phase_a, amplitude_b, phase_b, ignore_phase: bool = False) -> float:
        """The energy of two patterns, in single precision; needs no corpus. Raises InvalidPattern."""
        a, p = patterns.checked(amplitude_a, phase_a, None, self.config)
        b, q = patterns.checked(amplitude_b, phase_b, len(a), self.config)
        import numpy as np

        flat = [0.0] * len(a)
        energy = kernel.scores(np.array([b]), np.array([flat if ignore_phase else q]), np.array(a), np.array(flat if ignore_phase else p))[0][0]
        return float(np.float32(energy))

    def query(self, corpus: str, amplitude, phase, k: int | None = None, mode: str = "exact", detailed: bool = False) -> DataFrame:
        """Matches (float energy) in order, arrays included; mode routed searches near mean phases only.

        Ranking sees narrow rows; the arrays of at most top_k_max matches are fetched by id afterwards.
        """
        psi, table = self.pattern(corpus, amplitude, phase), self.table(corpus)
        if mode == "routed":
            found = routing.query_routed(table, psi, k, detailed=detailed, config=self.config)
        else:
            found = (query.query_detailed if detailed else query.query)(table, psi, k)
        names = ["id", "energy", "priority"] + ["phase_delta", "zone", "zone_score"] * detailed
        return query.materialise(found.select(*names), table.select("id", "amplitude", "phase", "metadata")).orderBy(*query.ranking("id"))

    def query_interference(self, corpus: str, amplitude, phase, k: int | None = None) -> DataFrame:
        """One row: the query and its detailed matches in order."""
        return query.interference(self.table(corpus), self.pattern(corpus, amplitude, phase), k)

    def query_interference_map(self, corpus: str, amplitude, phase, k: int | None = None) -> DataFrame:
        """id, energy, phase_shift and zone of the detailed matches."""
        return query.interference_entries(self.table(corpus), self.pattern(corpus, amplitude, phase), k).select("id", "energy", "phase_shift", "zone")

    def query_composite(self, corpus: str, composed: list, weights: list[float] | None = None, k: int | None = None, detailed: bool = False) -> DataFrame:
        """query of the weighted superposition of (amplitude, phase) pairs."""
        parts = [(w, list(map(float, a)), list(map(float, p))) for w, (a, p) in zip(patterns.weights_for(len(composed), weights), composed, strict=True)]
        for _, a, p in parts:
            self.pattern(corpus, a, p)
        one = patterns.superpose(self.spark.createDataFrame(parts, "w double, amplitude array<double>, phase array<double>"), F.col("w")).first()
        return self.query(corpus, one.amplitude, one.phase, k, detailed=detailed)
