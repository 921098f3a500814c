import re

from pyspark.sql import functions as F

import corpus_pipeline as pipe

from . import docs
from .test_linededup import brute as lines_of
from .test_packing import check
from .test_quality import brute as quality_of
from .test_secretscan import brute as secrets_of

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    before = spark.read.parquet(f"{SF}/documents.parquet")
    names = before.columns
    rows = [tuple(r) for r in before.collect()]
    got = pipe.quality_rules(spark, before, SF)
    kept = {tuple(r) for r in got.collect()}
    assert got.columns == names and kept == {r for r in rows if quality_of(r[1])[-1]}
    assert got.where(F.length("text") > 5).count() <= len(kept)

    source = spark.createDataFrame(sorted(kept), before.schema)
    lines = pipe.line_dedup(spark, source, SF)
    want = {(r[0], r[1]) for r in lines_of(sorted(kept))}
    assert lines.columns == names and {(r.doc_id, r.text) for r in lines.collect()} == want and all(r.n_chars == len(r.text) for r in lines.collect())

    fewer = pipe.near_dedup(spark, lines, SF)
    left = {r.doc_id: r.text for r in fewer.collect()}
    assert fewer.columns == names and set(left.items()) <= want
    first = {}
    for i, t in sorted(want):
        first.setdefault(t, i)
    assert len(set(left.values())) == len(left)  # no exact copies
    assert len(left) >= 0.75 * len(first)

    masked = pipe.secret_scan(spark, fewer, SF)
    after = {r.doc_id: r.text for r in masked.collect()}
    assert masked.columns == names and set(after) == set(left)
    for i, t in left.items():
        if secrets_of(t):
            assert "[SECRET]" in after[i] and not any(t[a:b] in after[i] for a, _, b, k in secrets_of(t) if k == "hex")
        elif after[i] != t:  # random spans only: what surrounds them stays, in order
            parts = after[i].split("[SECRET]")
            assert len(parts) > 1 and re.fullmatch(r"[A-Za-z0-9+/_=-]{20,}".join(map(re.escape, parts)), t)

    packed = pipe.pack(spark, masked, SF).collect()
    assert check(packed, list(after.items())) == 0


def test_run_and_odd_rows(spark, tmp_path):
    docs.table(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipe.run(spark, str(tmp_path)).count() > 0
    docs.empty(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert pipe.run(spark, f"{tmp_path}/e").count() == 0


def test_near_dedup_keeps_one_text_without_words(spark):
    rows = [(7, "", "en", "s", 0), (3, None, "en", "s", None), (5, " \n", "en", "s", 2), (9, "", "de", "t", 0), (4, "some words", "en", "s", 10), (None, "", "en", "s", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in pipe.near_dedup(spark, table, SF).collect()} == {3, 4, None}
