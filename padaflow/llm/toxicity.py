"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Counts of every training document give each hashed n-gram a log ratio of its smoothed shares in
toxic and other documents.  N-grams whose document counts don't differ significantly get ratio 0.
A logistic regression on presence times ratio is fitted in numpy on a bounded, documented sample
of the training rows; its intercept is then set for the class shares of all training rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padaflow.llm.common import Scratch, arrow_map, side_join, small_batches

#: log2 of the number of hashed features; it bounds the model, 4 bytes each.
BITS = 18
SIZES = (4, 5, 6)
#: The most training documents of each class that the regression is fitted on.
SAMPLE = 1500
#: A feature counts if its two document shares differ by so many standard errors.
SIGNIFICANCE = 4.5
THRESHOLD = 0.3


def ngram_ids(text: str, bits: int = BITS, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """The hashed character n-grams of a whole lower-cased text, white space as one blank."""
    code = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le"), dtype=np.uint32)
    out, h = [], np.full(len(code), 2166136261, dtype=np.uint32)
    for n in range(1, max(sizes) + 1):
        h = h[: len(code) - n + 1] * np.uint32(16777619) + code[n - 1 :] * np.uint32(2654435761)
        if n in sizes and len(h):
            out.append((h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


def _counts(bits: int, sizes: tuple[int, ...]):
    """Partial document counts by class of each feature, one set of rows per task."""

    def run(batches):
        total = np.zeros((2, 1 << bits), dtype=np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                total[toxic, np.unique(ngram_ids(text or "", bits, sizes))] += 1
        has = np.flatnonzero(total.any(axis=0))
        yield pa.record_batch([pa.array(has), pa.array(total[0, has]), pa.array(total[1, has])], names=["f", "neg", "pos"])

    return run


def _features(keep: np.ndarray, bits: int, sizes: tuple[int, ...]):
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text in batch.column("text").to_pylist():
                ids = ngram_ids(text or "", bits, sizes)
                out.append(np.unique(ids[keep[ids]]).astype("<u4").tobytes())
            return pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array(out, pa.binary())], names=["doc_id", "toxic", "ids"])

        return step

    return make


def fit_logistic(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, l2: float = 1.0, steps: int = 200, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and intercept of a regularised logistic regression on presence * scale, by Adam on all rows."""
    ids = np.concatenate(rows) if len(rows) else np.empty(0, np.uint32)
    used = np.flatnonzero(np.bincount(ids, minlength=len(scale)))
    col = np.searchsorted(used, ids).astype(np.int32)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    value = scale[ids].astype(np.float32)
    del ids
    n, w = max(1, len(rows)), np.zeros(len(used) + 1)  # the last one is the intercept
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(row, value * w[col], minlength=len(rows)) + w[-1]
        err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels
        g = np.append(np.bincount(col, value * err[row], minlength=len(used)) + l2 * w[:-1], err.sum()) / n
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w -= rate * (1 - t / (steps + 1)) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
    full = np.zeros(len(scale))
    full[used] = w[:-1]
    return full * scale, float(w[-1])


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, bits: int = BITS, sizes: tuple[int, ...] = SIZES, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights by feature, and the intercept.  ``labels(doc_id, toxic)`` holds the training rows alone.

    Null labels are ignored; the highest label of a repeated doc_id counts.  With one class only,
    all weights are 0 and the intercept follows the share of the class.
    """
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    labels = scratch.table(labels, "labels")
    docs = docs.select("doc_id", "text")
    known = side_join(docs, labels, "doc_id")
    sums = known.select("text", "toxic").mapInArrow(_counts(bits, sizes), "f bigint, neg bigint, pos bigint").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    sums = sums.toPandas()  # at most 2**bits rows
    totals = labels.groupBy("toxic").count().collect()
    n = np.zeros(2)
    for r in totals:
        n[r["toxic"]] = r["count"]
    prior = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
    neg, pos = np.zeros(1 << bits), np.zeros(1 << bits)
    neg[sums["f"].to_numpy(dtype=np.int64)], pos[sums["f"].to_numpy(dtype=np.int64)] = sums["neg"], sums["pos"]
    if not n.all():
        return np.zeros(1 << bits), prior
    p, q = (pos + 1) / (pos.sum() + len(pos)), (neg + 1) / (neg.sum() + len(neg))
    ratio = np.log(p / q)
    share = (pos + neg) / n.sum()
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n[0] + 1 / n[1]))
    ratio[np.abs(pos / n[1] - neg / n[0]) < SIGNIFICANCE * error] = 0
    ranked = F.xxhash64("doc_id")
    chosen = [labels.where(F.col("toxic") == c).orderBy(ranked, "doc_id").limit(sample) for c in (0, 1)]  # the fitting sample
    chosen = scratch.table(chosen[0].union(chosen[1]), "sample")
    rows = arrow_map(side_join(docs, chosen, "doc_id"), _features(ratio != 0, bits, sizes), "doc_id bigint, toxic int, ids binary").toPandas().sort_values("doc_id")
    y = rows["toxic"].to_numpy(dtype=float)
    if not 0 < y.sum() < len(y):
        return np.zeros(1 << bits), prior
    w, b = fit_logistic([np.frombuffer(x, dtype="<u4") for x in rows["ids"]], y, ratio)
    return w, b + prior - float(np.log(y.sum() / (len(y) - y.sum())))


def _score(weights: np.ndarray, intercept: float, bits: int, sizes: tuple[int, ...]):
    keep, small = weights != 0, weights

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            z = []
            for text in batch.column("text").to_pylist():
                ids = ngram_ids(text or "", bits, sizes)
                z.append(intercept + small[np.unique(ids[keep[ids]])].sum())
            return pa.record_batch([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))), pa.float64())], names=["doc_id", "score"])

        return step

    return make


def toxicity(docs: DataFrame, labels: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, held_out, score, predicted.

    Labels are learnt only from rows whose crc32(doc_id as text) mod 4 is not 2; the others are
    held out.  Null and empty texts get the score of the intercept.  A null doc_id is never a
    training row and not held out.  Other columns of both tables are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    out_of = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~out_of)
    weights, intercept = train(docs, labels, scratch)
    scored = arrow_map(docs, _score(weights, intercept, BITS, SIZES), "doc_id bigint, score double")
    return scored.select("doc_id", out_of.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
