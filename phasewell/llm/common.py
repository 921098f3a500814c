"""Shared folders and Arrow helpers of the training-data operators."""

from __future__ import annotations

import atexit
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Parameters: rows and bytes at most in one Arrow batch, so that a batch of long texts fits a Python worker.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local default only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:/tmp/checkpoints/phasewell"
    return base.rstrip("/")


class Work:
    """Tables of one operator call, written as Parquet in the shared folder; they outlive lost executors.

    A lazy result reads them, so they stay until release() or the end of the driver.
    """

    left: list[Work] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Work.left.append(self)
        batched(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        delete(self.spark, self.path(name))


def hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def release(since: int = 0) -> None:
    """Deletes the tables of all operator calls but the first since ones; results that read them must be written by then."""
    while len(Work.left) > since:
        work = Work.left.pop()
        if work.spark.sparkContext._jsc is not None:
            delete(work.spark, work.root)


atexit.register(release)


def batched(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes; results are lazy, so the session keeps the setting. A tighter one stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key).rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None for null."""
    return column.cast(pa.large_binary()).to_pylist()


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Partitions so that each task holds about rows_per_task rows, and no fewer than the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task), 1)
