"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams (bytes of the lower-cased text, SIZES long, hashed into BUCKETS).
For each feature, r = log((a + p) / (a + P)) - log((a + q) / (a + Q)) with p of P toxic and q of Q other labelled texts
that hold it; r is 0 where p does not differ from its expected value by DEVIATIONS standard deviations. A logistic regression is fitted to features scaled by r: its weights times r make one vector, and a text's score is
the logistic function of a bias and the sum of that vector over the features it holds, so very long texts are judged
by what they hold and not by how often. Labels, language, source and id are never inputs.

Training takes at most SAMPLE labelled rows of each class, those with the least hash of their id (documented bound:
SAMPLE rows of TEXT_BYTES at most reach the driver); rows whose crc32(doc_id) mod 3 is 1 are held out. The model has
BUCKETS numbers whatever the corpus. Scoring is one narrow pass in Arrow batches over all rows and whole texts.

Defined results: null or empty text: the score of the bias alone. Documents without a label are scored like others; null
labels are left out of training. With labels of one class only, or none, the score is the share of toxic labels (0 if
none). Repeated rows: equal scores. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .bytesops import _LOWER, buffers, mix, pieces

SIZES, BUCKETS = (4, 6, 8), 1 << 20
SAMPLE, TEXT_BYTES = 3000, 32 << 10
#: Smoothing; least texts that hold a feature; least standard deviations from its expected share of toxic texts; weight of the toxic class.
ALPHA, LEAST, DEVIATIONS, POSITIVE = 5.0, 8, 6.0, 0.4
THRESHOLD = 0.7
#: A-Z lower-cased, white space one character, so that a space in an n-gram is a word's edge.
_FOLD = _LOWER.copy()
_FOLD[9:14] = 32


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a run of bytes, position by position, one array for each size."""
    b = raw.astype(np.uint64)
    h = np.zeros(len(b) + 1, np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(b) < n:
            return
        h = h[: len(b) - n + 1] * np.uint64(257) + b[n - 1 :]
        if n in SIZES:
            yield (mix(h + np.uint64(n << 56)) & np.uint64(BUCKETS - 1)).astype(np.int32)


def row_features(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, row) of all rows of a piece, a pair of arrays for each size; n-grams across rows are left out."""
    n = len(off) - 1
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))
    for size, f in zip(SIZES, features(_FOLD[raw])):
        own = owner[: len(f)]
        inside = own == owner[size - 1 :]
        yield f[inside], own[inside]


def distinct(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct features, in row order, and their row."""
    found = list(row_features(raw, off))
    key = np.unique(np.concatenate([own.astype(np.int64) * BUCKETS + f for f, own in found])) if found else np.zeros(0, np.int64)
    return (key % BUCKETS).astype(np.int32), (key // BUCKETS).astype(np.int32)


def train(texts: pa.Array, toxic: np.ndarray, rounds: int = 100, rate: float = 60.0, l2: float = 1e-5) -> tuple[float, np.ndarray]:
    """Bias and weights: full-batch gradient steps with momentum on the scaled, distinct features."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    logit = lambda p: float(np.log(max(p, 1e-6) / max(1 - p, 1e-6)))
    if share in (0.0, 1.0):
        return logit(share), np.zeros(BUCKETS, np.float32)
    raw, off = buffers(texts)
    y = toxic.astype(np.float64)
    p, q = np.zeros(BUCKETS), np.zeros(BUCKETS)
    with np.errstate(over="ignore"):
        for i, j in pieces(off, 1 << 20):
            f, row = distinct(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            held = np.bincount(f, y[i:j][row], BUCKETS)
            p += held
            q += np.bincount(f, minlength=BUCKETS) - held
        r = np.log((ALPHA * share + p) / (ALPHA * share + y.sum())) - np.log((ALPHA * (1 - share) + q) / (ALPHA * (1 - share) + (1 - y).sum()))
        n = p + q
        far = np.abs(p - n * share) >= DEVIATIONS * np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
        r[(n < LEAST) | ~far] = 0
        made = []
        for i, j in pieces(off, 1 << 20):
            f, row = distinct(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            use = r[f] != 0
            made.append((f[use], row[use].astype(np.int64) + i))
    f, row = np.concatenate([x[0] for x in made]), np.concatenate([x[1] for x in made])
    norm = np.sqrt(max(np.bincount(row, r[f] ** 2, len(y)).max(), 1e-9))  # the heaviest text has norm 1
    x = r[f] / norm
    w, b, moved_w, moved_b = np.zeros(BUCKETS), logit(share), np.zeros(BUCKETS), 0.0
    each = np.where(y == 1, POSITIVE / y.sum(), (1 - POSITIVE) / (1 - y).sum())
    for _ in range(rounds):
        z = b + np.bincount(row, w[f] * x, len(y))
        e = each * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        moved_w = 0.9 * moved_w - rate * (np.bincount(f, e[row] * x, BUCKETS) + l2 * w)
        moved_b = 0.9 * moved_b - 2.0 * e.sum()
        w += moved_w
        b += moved_b
    return b, (w * r / norm).astype(np.float32)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of the sampled labelled rows that are not held out."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sampled = [usable.where(c).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(SAMPLE) for c in (F.col("toxic") == 1, F.col("toxic") == 0)]
    rows = sampled[0].unionByName(sampled[1])
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").where(F.octet_length("text") <= TEXT_BYTES).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[float, np.ndarray]:
    rows = training_rows(docs, labels).orderBy(F.md5("text")).toArrow()
    return train(rows.column("text").cast(pa.string()), np.array(rows.column("toxic").to_pylist(), np.int64))


def scores(column: pa.Array, bias: float, weights: np.ndarray) -> np.ndarray:
    raw, off = buffers(column)
    out = np.full(len(off) - 1, bias, np.float64)
    with np.errstate(over="ignore"):
        for i, j in pieces(off, 1 << 20):
            found = list(row_features(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
            if not found:
                continue
            heavy = [(f[k], own[k]) for f, own in found for k in [np.flatnonzero(weights[f])]]
            key = np.unique(np.concatenate([own.astype(np.int64) * BUCKETS + f for f, own in heavy]))
            out[i:j] += np.bincount(key // BUCKETS, weights[key % BUCKETS], j - i)
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def score(docs: DataFrame, model: tuple[float, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for every row."""
    bias, weights = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), bias, shared.value))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity; learned from labels that are not held out."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
