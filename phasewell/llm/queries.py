"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, licenses, linededup, packing, quality, secretscan, simhash, topk, urlfilter

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return langid.predict(docs, langid.fit(docs, ~held), held)


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_verdicts(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measures(table(spark, sf_dir, "documents")).drop("failed_rule")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(table(spark, sf_dir, "documents"), MULTI_RANKS, with_ids=False)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.spans(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secretscan.written(F.col("base")), 256).alias("base_sha256"), secretscan.written(F.col("found")).alias("spans"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT r, generate_subscripts(ws, 1) AS i, ws FROM w WHERE len(ws) >= 5),
g5 AS (SELECT r, i, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS k FROM g WHERE i + 4 <= len(ws)),
rep AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g5),
pos AS (SELECT DISTINCT r, i + o AS p FROM rep, (SELECT unnest(range(5)) AS o) WHERE c > 1),
n AS (SELECT r, count(*) AS n FROM pos GROUP BY r),
b AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN n USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 5 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars > 25 * n_words) AS kept
FROM b"""

def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's columns that SQL can express."""
    return op5_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's columns that SQL can express."""
    return op9_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def phrase_at(phrase: str) -> str:
    return "(" + " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split())) + ")"


LICENSES_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, list_filter(range(1, len(ws) + 1), lambda i: {" OR ".join(map(phrase_at, licenses.BASE))}) AS places,
  [{", ".join(f"CASE WHEN len(list_filter(range(1, len(ws) + 1), lambda i: {phrase_at(x)})) > 0 THEN '{label}' END" for x, label in licenses.BASE.items())}] AS labels FROM w)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) - 1 AS BIGINT) AS first_word,
  CAST(list_max(places) - 1 AS BIGINT) AS last_word, array_to_string(list_sort(list_filter(labels, lambda x: x IS NOT NULL)), ',') AS base_labels FROM p"""

SECRETS_SQL = "SELECT doc_id, " + ", ".join("CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '{}', {}), lambda x: length(x) >= {})) AS BIGINT) AS n_{}".format(pattern.replace("'", "''"), group, least, kind) for kind, pattern, _, group, least in secretscan.KINDS) + " FROM documents"

QUERIES = {f.__name__: f for f in (op1_topk, op2_simhash, op3_langid, op4_linededup, op5_licenses, op6_urlfilter, op7_quality, op8_bpe, op9_secrets, op10_packing, licenses_base, secrets_base)}
ORACLE = {"op1_topk": OP1_SQL, "op4_linededup": linededup.oracle(), "op6_urlfilter": urlfilter.oracle(), "op7_quality": OP7_SQL, "licenses_base": LICENSES_SQL, "secrets_base": SECRETS_SQL}
