import numpy as np
from pyspark.sql import functions as F

from phasewell.llm import langid, queries

from . import docs

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.op3_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([not r.rejected for r in got if r.lang_pred == r.lang]) > 0.9


def test_label_source_and_id_are_not_inputs(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    model = langid.fit(table, F.lit(True))
    one = langid.predict(table, model, F.lit(False)).select("lang_pred", "score").collect()
    moved = table.select((F.col("doc_id") * 0 + 5).alias("doc_id"), "text")
    assert one == langid.predict(moved, model, F.lit(False)).select("lang_pred", "score").collect()


def test_odd_rows(spark):
    table = docs.table(spark)
    got = langid.predict(table, langid.fit(table, F.lit(True)), F.lit(False)).collect()
    assert len(got) == table.count()
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in range(4))
    assert all(r.lang_pred in ("en", "de") for i, r in by.items() if i not in range(4) and i != len(docs.texts()) - 1)
    assert by[len(docs.texts()) - 1].lang_pred == "und"


def test_nothing_to_learn(spark):
    table = docs.table(spark)
    assert {(r.lang_pred, r.score) for r in langid.predict(table, langid.fit(table, F.lit(False)), F.lit(False)).collect()} == {("und", 0.0)}
    assert langid.predict(docs.empty(spark), langid.fit(docs.empty(spark), F.lit(True)), F.lit(False)).collect() == []


def test_bag_equals_long_and_short_paths(monkeypatch):
    text = "Ein längerer Text, with words and  spaces.".encode() * 30
    whole = langid.bag(text)
    model = langid.Model(["a", "b"], np.random.default_rng(1).normal(size=(langid.BUCKETS, 2)), np.zeros(2))
    z = model.logits(text)
    monkeypatch.setattr(langid, "SPAN", 7)
    cut = langid.bag(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all() and np.allclose(z, model.logits(text), atol=1e-4)


def slow(model, text):
    """Prediction written out: every window, one at a time."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in b" " + text.encode() + b" ")
    raw = bytes(b for i, b in enumerate(raw) if b != 32 or i and raw[i - 1] != 32)
    total, count = np.zeros(len(model.labels)), 0
    for n in (2, 3, 4):
        for i in range(len(raw) - n + 1):
            gram = 0
            for b in raw[i : i + n]:
                gram = (gram * 257 + b) % 2**32
            h = (gram ^ (n * 0x9E3779B1 % 2**32)) * 0x85EBCA6B % 2**32
            total += model.table[(h ^ (h >> 15)) % langid.BUCKETS]
            count += 1
    z = (total / max(count, 1) + model.bias) / model.temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    return model.labels[int(p.argmax())], p.max()


def test_every_prediction_against_slow_windows(spark):
    table = docs.table(spark)
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"), F.lit(True), sample=300)
    texts = [r[1] for r in docs.rows()]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, F.lit(None).cast("boolean")).collect()
    assert table.count() == len(texts) == len(got)
    for r in got:
        want = slow(model, texts[r.doc_id])
        assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-4 and r.held_out is False, r
