"""Pattern tables and small state files on any file system that Spark can reach."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewell.schema import PATTERN_SCHEMA


#: Parameter: state files that stay.
KEPT = 3


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def read_json(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the state files state-<n>.json in a folder, rising. Half-written ones have another name."""
    return sorted(int(m[1]) for n in names(spark, folder) if (m := re.fullmatch(r"state-(\d+)\.json", n)))


def read_state(spark: SparkSession, folder: str) -> dict | None:
    """The state of the highest version, None if there is none."""
    found = versions(spark, folder)
    return read_json(spark, f"{folder}/state-{found[-1]}.json") if found else None


def write_state(spark: SparkSession, folder: str, state: dict) -> None:
    """Adds state["version"]'s file: written beside its place and renamed, never over another. Nothing is deleted before,
    so at every moment a reader finds the old or the new state; older files but the last KEPT go afterwards."""
    path = f"{folder}/state-{state['version']}.json"
    fs, p = _fs(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/.{uuid.uuid4().hex}.tmp")
    stream = fs.create(beside, False)
    stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    stream.close()
    if fs.exists(p) or not fs.rename(beside, p):
        fs.delete(beside, False)
        raise OSError(f"{path} exists: another writer was first")
    for old in versions(spark, folder)[:-KEPT]:
        remove(spark, f"{folder}/state-{old}.json")


def read_patterns(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Patterns (id, amplitude, phase, metadata) from Parquet, ORC or JSON lines."""
    if form not in ("parquet", "orc", "json"):
        raise ValueError(f"can't read patterns from {form}")
    return spark.read.schema(PATTERN_SCHEMA).format(form).load(path)


def write_patterns(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    df.select("id", "amplitude", "phase", "metadata").write.format(form).mode(mode).save(path)


def write_tsv(matches: DataFrame, path: str) -> None:
    """Matches as tab-separated text: scores with 8 decimals, zone scores with 4."""
    number = {"energy": "%.8f", "phase_delta": "%.8f", "phase_shift": "%.8f", "zone_score": "%.4f"}
    columns = [F.format_string(number[c], F.col(c).cast("double")) if c in number else F.col(c).cast("string") for c in matches.columns if c in {"id", "zone", *number}]
    matches.select(F.concat_ws("\t", *columns)).write.text(path)
