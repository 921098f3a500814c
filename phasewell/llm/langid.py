"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the 2-, 3- and 4-byte windows of its UTF-8 form with A-Z lower-cased, in which every ASCII byte that
isn't a letter is a space (bytes of other characters, be they letters or not, stay); each is hashed to one of BUCKETS embeddings. The text is the mean of its
embeddings, a linear layer and a softmax follow. Embeddings and layer are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows (SAMPLE rows, lowest hash of the id first); a fifth of
it is held back to fit the softmax temperature and the score below which a prediction is marked as rejected.

The threshold only sets the column rejected; lang_pred stays the likeliest label, as callers may want it all the same.

Edge cases. A null text, or one without a letter, is "und" with score 0. Rows without a label or an id
teach nothing; a row whose held_out is null isn't held out. Without any labelled row every text is "und". Ties go to the label first in the alphabet.
Repeated rows get the same prediction; an empty table gives an empty result; other columns are ignored.
Whole texts are read, in training as in prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batched

#: Parameters: the sample's bound, buckets, embedding size, passes, step size, share of errors that
#: the rejection threshold lets through on the held-back fifth.
SAMPLE = 3000
BUCKETS = 1 << 15
SIZE = 16
EPOCHS = 8
RATE = 0.5
ERRORS = 0.01
SPAN = 1 << 20

#: Byte classes: ASCII letters lower-cased, bytes of longer characters kept, the rest a space.
CLASS = np.full(256, 32, np.uint8)
CLASS[97:123] = np.arange(97, 123)
CLASS[65:91] = np.arange(97, 123)
CLASS[128:] = np.arange(128, 256)


def subwords(text: bytes) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's subwords, in arrays of bounded size."""
    raw = CLASS[np.frombuffer(b" " + text + b" ", np.uint8)]
    solid = raw != 32
    solid[1:] |= raw[:-1] != 32  # of each run of spaces one is left
    raw = raw[solid]
    for at in range(0, max(1, len(raw) - 1), SPAN):
        x = raw[at : at + SPAN + 3].astype(np.uint32)
        if len(x) < 2:
            return
        gram = x[:-1] * np.uint32(257) + x[1:]
        yield bucket(gram[:SPAN], 2)
        for n in (3, 4):
            if len(x) >= n:
                gram = gram[:-1] * np.uint32(257) + x[n - 1 :]
                yield bucket(gram[:SPAN], n)


def bucket(gram: np.ndarray, n: int) -> np.ndarray:
    h = (gram ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    return ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int64)


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and how often each occurs."""
    counts = np.zeros(BUCKETS, np.int64)
    for b in subwords(text):
        counts += np.bincount(b, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


class Model:
    """Labels, the label scores of each bucket (embeddings times layer) with the bias, and calibration."""

    def __init__(self, labels, table, bias, temperature=1.0, reject=0.0):
        self.labels, self.table, self.bias, self.temperature, self.reject = labels, table.astype(np.float32), bias, temperature, reject

    def logits(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.labels)), 0
        for b in subwords(text):
            counts = np.bincount(b, minlength=BUCKETS) if len(b) > BUCKETS // 2 else None
            total += counts @ self.table if counts is not None else self.table[b].sum(axis=0, dtype=np.float64)
            n += len(b)
        return total / max(n, 1) + self.bias

    def predict(self, text: bytes) -> tuple[str, float]:
        p = softmax(self.logits(text)[None, :] / self.temperature)[0]
        best = int(p.argmax())
        return self.labels[best], float(min(1.0, max(0.0, p[best])))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = 7) -> Model | None:
    """Fits on four fifths of the bags; the last fifth calibrates. None if there is nothing to learn."""
    labels = sorted(set(langs))
    if not labels:
        return None
    y = np.array([labels.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    emb, layer, bias = rng.normal(0, 0.1, (BUCKETS, SIZE)), rng.normal(0, 0.1, (SIZE, len(labels))), np.zeros(len(labels))
    weight = [c / max(1, c.sum()) for _, c in bags]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(fit):
            at, w = bags[i][0], weight[i]
            mean = w @ emb[at]
            slope = softmax((mean @ layer + bias)[None, :])[0]
            slope[y[i]] -= 1
            back = layer @ slope
            layer -= rate * np.outer(mean, slope)
            bias -= 0.1 * rate * slope
            emb[at] -= (rate * min(len(at), 50)) * np.outer(w, back)
    model = Model(labels, emb @ layer, bias)
    if len(held):
        z = np.array([weight[i] @ model.table[bags[i][0]] + bias for i in held], np.float64)
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
        p = softmax(z / model.temperature)
        top, right = p.max(axis=1), p.argmax(axis=1) == y[held]
        rank = np.argsort(-top)
        wrong = np.cumsum(~right[rank]) / np.arange(1, len(held) + 1)
        good = np.flatnonzero(wrong <= ERRORS)
        model.reject = float(top[rank][good[-1]]) if len(good) else 1.0
    return model


def fit(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Trains on at most sample rows for which learn holds and the label isn't null."""
    ok = learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull()
    key = F.xxhash64(F.col(id_col).cast("long"))
    edge = df.where(ok).select(key.alias("k")).orderBy("k").limit(sample).agg(F.max("k")).first()[0]
    if edge is None:
        return None

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [bag(t) for t in as_bytes(b.column(0))]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([x for x, _ in got], pa.list_(pa.int32())), pa.array([c for _, c in got], pa.list_(pa.int32()))], names=["lang", "k", "at", "n"])

    rows = df.where(ok & (key <= edge)).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), key.alias("k"))
    got = rows.mapInArrow(bags, "lang string, k long, at array<int>, n array<int>").orderBy("k", "lang").limit(sample).toArrow()
    at, n = ([x.values.to_numpy() for x in got[c]] for c in ("at", "n"))  # views, no Python numbers
    return train(list(zip(at, n, strict=True)), got["lang"].to_pylist())


def predict(df: DataFrame, model: Model | None, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected (score below the calibrated threshold) of each row."""
    spark = df.sparkSession
    batched(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = [m.predict(t) if m and letter and t is not None else ("und", 0.0) for t, letter in zip(as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True)]
            lang, score = pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())
            rejected = pa.array([m is None or s < m.reject for _, s in out], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lang, score, rejected], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text.alias("text"), text.rlike(r"\p{L}").alias("letter"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
