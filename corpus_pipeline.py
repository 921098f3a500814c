"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before kept. All but the last return
the columns of documents; where a stage changes texts, n_chars follows. Null and empty texts, repeated rows, ties and
empty tables are defined by the operators that the stages call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewell.llm import linededup, packing, quality, secretscan, simhash
from phasewell.llm.common import Work, release
from phasewell.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.apply_rules(docs.select(*COLUMNS)).where("failed_rule IS NULL").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more documents share."""
    return counted(linededup.drop_common_lines(docs.select(*COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (five-word shingles, similarity 0.8 or more); texts without words are one."""
    return simhash.near_dedup(docs.select(*COLUMNS), one_blank=True).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked."""
    found = secretscan.spans(docs.withColumn("doc_id", F.col("doc_id").cast("long")), COLUMNS)
    return counted(found.withColumn("text", secretscan.masked(F.col("text"), F.col("found"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2,048 tokens."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("secret scan", secret_scan), ("packing", pack)]

#: SQL can't express fingerprints or tokens; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written in the shared folder and read again.

    A stage's own tables, and the result before it, go as soon as its result is written.
    """
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        since = len(Work.left)
        docs = work.save(stage(spark, docs, sf_dir), f"stage-{k}")
        release(since)
        if k:
            work.drop(f"stage-{k - 1}")
    return docs
