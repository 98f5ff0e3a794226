"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

An n-gram counts once a document. Its log-count ratio compares the share of toxic and of other documents that hold it;
logistic regression with an L2 penalty is then fitted to the presences times these ratios. Fitting uses a bounded
sample of labelled rows, whose counts and presences are worked out where the texts are; scoring passes over every whole text
in Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findoc.llm.common import map_batches, release
from findoc.llm.fitting import TASKS, labelled_texts
from findoc.llm.ngrams import chunks, ngram_buckets

#: n-grams are hashed into 2 ** BITS buckets.
BITS = 20
#: Texts are scored together up to so many characters, which bounds a worker's memory; a longer text is scored alone.
TOGETHER = 400_000


@dataclass
class ToxicityModel:
    """``slot`` maps a bucket to its feature or -1; ``weights`` hold ratio times coefficient."""

    orders: tuple[int, ...]
    slot: np.ndarray
    weights: np.ndarray
    bias: float

    def presences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of every feature that a text holds, once each."""
        size, keys = max(1, len(self.weights)), []
        for buckets, owner in ngram_buckets(texts, self.orders, BITS):
            feature = self.slot[buckets]
            there = np.flatnonzero(feature >= 0)
            keys.append(np.unique(owner[there] * size + feature[there]))
        keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        return keys // size, keys % size

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for start, part in chunks(texts, TOGETHER):
            text, feature = self.presences(part)
            z = self.bias + (np.bincount(text, self.weights[feature], minlength=len(part)) if len(text) else np.zeros(len(part)))
            out[start : start + len(part)] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def counts_of(texts: list[str], labels: np.ndarray, orders: tuple[int, ...]) -> np.ndarray:
    """(label, bucket): in how many texts of a label an n-gram of the bucket is."""
    counts = np.zeros((2, 1 << BITS), dtype=np.int64)
    for text, label in zip(texts, labels, strict=True):
        own = [b for b, _ in ngram_buckets([text], orders, BITS)]
        counts[int(label), np.unique(np.concatenate(own))] += 1
    return counts


def choose_features(counts: np.ndarray, toxic: int, n: int, orders: tuple[int, ...], features: int = 1024, smoothing: float = 1.0) -> ToxicityModel:
    """The ``features`` buckets that part the classes best, weighted by their log-count ratios. With fewer than two classes nothing can be told apart: there are none, and every text scores 0."""
    slot = np.full(1 << BITS, -1, dtype=np.int32)
    if n == 0 or toxic in (0, n):
        return ToxicityModel(orders, slot, np.zeros(0), -40.0)
    p, q = (counts[1] + smoothing) / (toxic + 2 * smoothing), (counts[0] + smoothing) / (n - toxic + 2 * smoothing)
    both = (counts.sum(axis=0) + smoothing) / (n + 2 * smoothing)
    strength = np.abs(p - q) / np.sqrt(both * (1 - both) * (1 / toxic + 1 / (n - toxic)))
    strength[counts.sum(axis=0) < 2] = 0
    chosen = np.argsort(-strength, kind="stable")[:features]
    slot[chosen] = np.arange(len(chosen), dtype=np.int32)
    return ToxicityModel(orders, slot, np.log(p / q)[chosen], 0.0)


def packed_presences(model: ToxicityModel, texts: list[str]) -> np.ndarray:
    """(text, bits): which features each text holds, eight in a byte."""
    out = np.zeros((len(texts), len(model.weights)), dtype=bool)
    for start, part in chunks(texts, TOGETHER):
        text, feature = model.presences(part)
        out[start + text, feature] = True
    return np.packbits(out, axis=1)


def fit_presences(model: ToxicityModel, packed: np.ndarray, labels: np.ndarray, penalty: float = 1.0, steps: int = 12) -> ToxicityModel:
    """Logistic regression on presences times log-count ratios, by Newton's method."""
    ratio = model.weights
    x = np.ones((len(labels), len(ratio) + 1), dtype=np.float32)
    x[:, :-1] = np.unpackbits(packed, axis=1, count=len(ratio)) * ratio
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        prob = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (prob - labels) + ridge * w
        curve = (x.T * np.maximum(prob * (1 - prob), 1e-6).astype(np.float32)) @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return ToxicityModel(model.orders, model.slot, ratio * w[:-1], float(w[-1]))


def fit_texts(texts: list[str], labels: np.ndarray, orders: tuple[int, ...] = (3, 4, 5, 6), features: int = 1024, smoothing: float = 1.0, penalty: float = 1.0, steps: int = 12) -> ToxicityModel:
    """Fit on texts and 0/1 labels in memory."""
    labels = np.asarray(labels, dtype=np.float64)
    model = choose_features(counts_of(texts, labels, orders), int(labels.sum()), len(labels), orders, features, smoothing)
    return fit_presences(model, packed_presences(model, texts), labels, penalty, steps) if len(model.weights) else model


def fit(sample: DataFrame, orders: tuple[int, ...] = (3, 4, 5, 6), features: int = 1024, smoothing: float = 1.0, **settings) -> ToxicityModel:
    """The same fit on a bounded table (text, y). No text reaches the driver: counts of fixed size a task, then a bit a feature and text."""
    tasks = sample.select("text", "y").coalesce(TASKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((2, 1 << BITS), dtype=np.int64), [0, 0]
        for batch in batches:
            y = batch.column(1).to_numpy()
            sums += counts_of(batch.column(0).to_pylist(), y, orders)
            n = [n[0] + int((y == 0).sum()), n[1] + int((y == 1).sum())]
        packed = [zlib.compress(s.astype("<u4").tobytes(), 1) for s in sums]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], ["y", "n", "counts"])

    counts, n = np.zeros((2, 1 << BITS), dtype=np.int64), [0, 0]
    for row in tasks.mapInArrow(count, "y int, n long, counts binary").collect():
        counts[row["y"]] += np.frombuffer(zlib.decompress(row["counts"]), dtype="<u4")
        n[row["y"]] += row["n"]
    model = choose_features(counts, n[1], sum(n), orders, features, smoothing)
    if not len(model.weights):
        return model

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            bits = packed_presences(model, batch.column(0).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array([b.tobytes() for b in bits], pa.binary())], ["y", "bits"])

        return each

    rows = sorted((r["bits"], r["y"]) for r in map_batches(tasks, make, "y int, bits binary").collect())  # the same model whatever the order of rows
    return fit_presences(model, np.frombuffer(b"".join(r[0] for r in rows), dtype=np.uint8).reshape(len(rows), -1), np.array([r[1] for r in rows], dtype=np.float64), **settings)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold) for each row of ``docs``.

    A null text scores as the empty text; whole texts are read, however long. Rows repeat as they come, equal texts score
    alike; no rows give no rows. Other columns of ``docs`` are ignored, whatever their names.
    """
    kind = dict(docs.dtypes)[id_col]
    kind = kind if kind in ("bigint", "int", "string") else "string"

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = model.score([t or "" for t in batch.column(1).to_pylist()])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

        return each

    rows = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, make, f"doc_id {kind}, score double, predicted int")


def clean_rows(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, each by its own text, whatever its id."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(model.score([t or "" for t in batch.column(batch.schema.names.index(text_col)).to_pylist()]) < threshold))

        return each

    return map_batches(docs, make, docs.schema)


def train_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, max_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **settings) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold.

    Rows without a label or an id do not count; a null text is empty. An id with several labels counts once for each. With
    fewer than two classes nothing is learned and every text scores 0. Other columns of both tables are ignored, whatever their names.
    """
    sample = labelled_texts(docs, labels, label_col, folds, held_out, max_rows, id_col, text_col)
    model = fit(sample, **settings)
    release(sample)
    return model
