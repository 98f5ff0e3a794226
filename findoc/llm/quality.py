"""Quality: histogram gradient-boosted trees over statistics of a document.

The statistics of every whole text are computed in Arrow batches. Trees are grown on the driver from a bounded sample
of labelled rows (numbers only), level by level from histograms of binned statistics, and flattened into arrays that
numpy walks for all rows of a batch at once.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findoc.llm.common import map_batches, release
from findoc.llm.fitting import labelled_texts

STATISTICS = (
    "chars", "words", "lines", "word_length", "word_length_spread", "longest_word", "letters", "digits", "upper", "spaces",
    "marks", "symbols", "non_ascii", "distinct_words", "top_word", "top_pair", "repeated_triples", "line_length",
    "repeated_lines", "repeated_line_chars", "lines_closed", "short_lines", "short_words", "long_words", "words_with_symbol",
    "words_upper", "words_capital", "char_entropy", "words_per_mark", "common_words", "distinct_chars", "ellipses",
)

#: Frequent words of the four languages.
COMMON = frozenset("the and of to in is that it for on was with as are be this by from at or an der die das und ist von den mit ein eine zu des auf für im le la les de des et un une que en dans est pour du el los las y que en por con una del al se".split())

_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()-]")
_CLASS = np.zeros(128, dtype=np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 mark
_CLASS[[*range(97, 123)]], _CLASS[[*range(65, 91)]], _CLASS[[*range(48, 58)]] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4, 5


def statistics(text: str) -> list[float]:
    """STATISTICS of a whole text; all zero for the empty one."""
    if not text:
        return [0.0] * len(STATISTICS)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    n = len(points)
    wide = points >= 128
    kinds = np.bincount(_CLASS[points[~wide]], minlength=6)
    n_wide = int(wide.sum())
    shares = np.unique(points, return_counts=True)[1] / n
    words = text.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    lines = [line for line in text.split("\n") if line.strip()]
    m = max(1, len(lines))
    by_line = Counter(lines)
    again = {line: c for line, c in by_line.items() if c > 1}
    return [
        float(n), float(len(words)), float(len(lines)), float(sizes.mean()), float(sizes.std()), float(sizes.max()),
        (kinds[1] + kinds[2] + n_wide) / n, kinds[3] / n, kinds[2] / n, kinds[4] / n, kinds[5] / n, kinds[0] / n, n_wide / n,
        len(counts) / w, max(counts.values(), default=0) / w, max(pairs.values(), default=0) / w,
        sum(c for c in triples.values() if c > 1) / w, sum(map(len, lines)) / m, sum(c - 1 for c in again.values()) / m,
        sum(len(line) * (c - 1) for line, c in again.items()) / n, sum(line.rstrip().endswith((".", "!", "?", '"')) for line in lines) / m,
        sum(len(line) < 30 for line in lines) / m, float((sizes <= 2).mean()), float((sizes > 15).mean()),
        sum(c for x, c in counts.items() if _SYMBOL.search(x)) / w, sum(c for x, c in counts.items() if x.isupper()) / w,
        sum(c for x, c in counts.items() if x[:1].isupper()) / w, float(-(shares * np.log2(shares)).sum()),
        len(words) / (1 + kinds[5]), sum(c for x, c in counts.items() if x.strip(".,;:!?'\"()-").lower() in COMMON) / w, float(len(shares)),
        (text.count("...") + text.count("…")) / m,
    ]


@dataclass
class Trees:
    """Full binary trees of one depth, as arrays (tree, node): go right where statistic > threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            z += leaf[node - (2**depth - 1)]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, penalty: float = 2.0, least: float = 3.0) -> Trees:
    """Boost the logistic loss. With fewer than two classes there are no trees and the score is the share of label 1."""
    n, width = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if n == 0 or y.sum() in (0, n):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    z = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)  # within the level
        for level in range(depth):
            k = 2**level
            gain, best_feature, best_bin = np.full(k, 1e-6), np.full(k, -1), np.zeros(k, np.int64)
            for f in range(width):
                at = node * bins + binned[:, f]
                gl = np.bincount(at, g, k * bins).reshape(k, bins).cumsum(axis=1)
                hl = np.bincount(at, h, k * bins).reshape(k, bins).cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                won = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                won[(hl < least) | (ht - hl < least)] = 0
                won[:, len(edges[f]) :] = 0
                top = won.argmax(axis=1)
                better = won[np.arange(k), top] > gain
                gain[better], best_feature[better], best_bin[better] = won[np.arange(k), top][better], f, top[better]
            for j in np.flatnonzero(best_feature >= 0):
                feature[k - 1 + j], threshold[k - 1 + j] = best_feature[j], edges[best_feature[j]][best_bin[j]]
            at = k - 1 + node
            node = 2 * node + (x[np.arange(n), feature[at]] > threshold[at])
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        leaf = -rate * gs / (hs + penalty)
        z += leaf[node]
        features.append(feature)
        thresholds.append(threshold)
        values.append(leaf)
    return Trees(np.stack(features), np.stack(thresholds), np.stack(values), base)


def train_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, max_rows: int = 12000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **settings) -> Trees:
    """Grow trees from at most ``max_rows`` labelled documents outside the held-out fold; only their statistics reach the driver.

    Rows without a label or an id do not count; a null text is empty. No labels give a model without trees. Other columns
    of both tables are ignored, whatever their names.
    """
    sample = labelled_texts(docs, labels, label_col, folds, held_out, max_rows, id_col, text_col)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [statistics(t) for t in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

        return each

    got = map_batches(sample.select("text", "y"), make, "y int, x array<double>").toArrow()
    release(sample)
    rows = sorted(zip(got["x"].to_pylist(), got["y"].to_pylist(), strict=True))  # the same trees whatever the order of rows
    x = np.array([r[0] for r in rows], dtype=np.float64).reshape(-1, len(STATISTICS))
    return grow(x, np.array([r[1] for r in rows], dtype=np.float64), **settings)


def score_quality(docs: DataFrame, model: Trees, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold) for each row of ``docs``.

    A null text scores as the empty text; whole texts are read, however long. Rows repeat as they come, equal texts score
    alike; no rows give no rows. Other columns of ``docs`` are ignored, whatever their names.
    """
    kind = dict(docs.dtypes)[id_col]
    kind = kind if kind in ("bigint", "int", "string") else "string"

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = model.score(np.array([statistics(t or "") for t in batch.column(1).to_pylist()]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

        return each

    rows = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, make, f"doc_id {kind}, score double, predicted int")
