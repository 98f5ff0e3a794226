"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams that both hold, blended over the orders, divided by the
geometric mean of how many each holds. n-grams are held exactly, as their code points side by side in 63 bits. Landmark
texts give the Nyström approximation of the kernel's feature space, in which one ridge regression a language is fitted
against the rest. Scoring multiplies a batch's presence matrix, over the landmarks' n-grams, with the landmarks' and the
result with the coefficients. Fitting uses a bounded sample of labelled rows, whose kernel rows are worked out where the
texts are.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findoc.llm.common import BATCH_ROWS, map_batches, release, written
from findoc.llm.fitting import TASKS, bounded_sample, fold

#: Texts whose presences make one matrix.
ROWS = 64
#: A landmark holds at most so many different n-grams.
MOST_NGRAMS = 20_000


@functools.cache
def _kinds() -> np.ndarray:
    """Of every code point: 2 for a letter (category L), 1 for a mark that letters carry (M), else 0."""
    return np.frombuffer(bytes({"L": 2, "M": 1}.get(unicodedata.category(chr(k))[0], 0) for k in range(0x110000)), dtype=np.uint8)


def has_letter(text: str | None) -> bool:
    return bool(text) and (any(map(str.isalpha, text[:200])) or any(map(str.isalpha, text)))


def ngrams(text: str, orders: tuple[int, ...]) -> np.ndarray:
    """The distinct n-grams of a text in lower case, in which every run of characters other than letters is one space, as sorted keys."""
    if max(orders) > 3:
        raise ValueError("n-grams of up to three code points fit a key")
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    inside = _kinds()[points] > 0
    points[~inside] = 32
    inside[1:] |= inside[:-1].copy()  # the first of each run of others stays
    inside[0] = True
    points = points[inside]
    keys, value = [], np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(orders) + 1):
        value = (value[: len(points) - n + 1] << np.uint64(21)) | points[n - 1 :]
        if n in orders:
            keys.append(value)
    return np.unique(np.concatenate(keys))


@dataclass
class LanguageModel:
    orders: tuple[int, ...]
    languages: list[str]
    keys: np.ndarray  # the landmarks' n-grams, sorted
    held: np.ndarray  # n-gram, landmark: whether it holds it
    coefficients: np.ndarray  # landmark and constant, language

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "landmarks"}  # worked out again where it is needed

    @functools.cached_property
    def landmarks(self) -> np.ndarray:
        """Presences divided by the root of their number."""
        return (self.held / np.sqrt(np.maximum(self.held.sum(axis=0), 1))).astype(np.float32)

    def kernel(self, texts: list[str]) -> np.ndarray:
        """(text, landmark) of at most ROWS texts."""
        x, sizes = np.zeros((len(texts), len(self.keys)), dtype=np.float32), np.ones((len(texts), 1))
        for k, text in enumerate(texts):
            own = ngrams(text, self.orders)
            at = np.searchsorted(self.keys, own)
            at[at == len(self.keys)] = 0
            x[k, at[self.keys[at] == own] if len(self.keys) else []] = 1
            sizes[k] = max(1, len(own))
        return (x @ self.landmarks) / np.sqrt(sizes)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores; ``und`` with score 0 for null, for texts without a letter, and where nothing was learned."""
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        known = [k for k, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for at in range(0, len(known), ROWS):
            part = known[at : at + ROWS]
            z = np.hstack([self.kernel([texts[j] for j in part]), np.ones((len(part), 1), np.float32)]) @ self.coefficients
            best = z.argmax(axis=1)
            for j, b, s in zip(part, best, np.clip(z[np.arange(len(part)), best], 0, 1), strict=True):
                names[j], scores[j] = self.languages[b], float(s)
        return names, scores


def turns(langs: list[str], landmarks: int) -> list[int]:
    """Which rows are landmarks: the languages take turns."""
    seen: dict[str, int] = {}
    order = []
    for k, name in enumerate(langs):
        order.append((seen.get(name, 0), name, k))
        seen[name] = seen.get(name, 0) + 1
    return [k for _, _, k in sorted(order)[: max(landmarks, len(seen))]]


def with_landmarks(sets: list[np.ndarray], languages: list[str], orders: tuple[int, ...]) -> LanguageModel:
    keys = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    held = np.zeros((len(keys), len(sets)), dtype=bool)
    for k, own in enumerate(sets):
        held[np.searchsorted(keys, own), k] = True
    return LanguageModel(orders, languages, keys, held, np.zeros((0, 0)))


def fit_kernel(model: LanguageModel, kernel: np.ndarray, langs: list[str], ridge: float = 0.5) -> LanguageModel:
    """One-versus-rest ridge regression in the landmarks' feature space."""
    own = (model.landmarks.T @ model.landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(own)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    rows = np.hstack([kernel @ root, np.ones((len(kernel), 1))])
    y = np.array([[float(name == language) for language in model.languages] for name in langs])
    w = np.linalg.solve(rows.T @ rows + ridge * np.eye(rows.shape[1]), rows.T @ y)
    coefficients = np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32)
    return LanguageModel(model.orders, model.languages, model.keys, model.held, coefficients)


def fit_texts(texts: list[str], langs: list[str], orders: tuple[int, ...] = (1, 2, 3), landmarks: int = 96, ridge: float = 0.5) -> LanguageModel:
    """Fit on texts in memory. No rows give a model that knows no language."""
    if not texts:
        return with_landmarks([], [], orders)
    model = with_landmarks([ngrams(texts[k], orders) for k in turns(langs, landmarks)], sorted(set(langs)), orders)
    return fit_kernel(model, np.vstack([model.kernel(texts[at : at + ROWS]) for at in range(0, len(texts), ROWS)]), langs, ridge)


def train_language(docs: DataFrame, folds: int = 4, held_out: int = 2, max_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", orders: tuple[int, ...] = (1, 2, 3), landmarks: int = 96, ridge: float = 0.5) -> LanguageModel:
    """Fit on at most ``max_rows`` documents outside the held-out fold that have a language and a text with a letter.

    Landmarks are texts of at most MOST_NGRAMS different n-grams; of their texts the n-grams reach the driver, of the others a
    kernel row. Rows with a null id, language or text do not count. Other columns are ignored, whatever their names.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(F.col(id_col), folds) != held_out))
    known = known.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sample = written(bounded_sample(known, max_rows, "id").repartition(TASKS), "sample", BATCH_ROWS)

    def sizes():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = [len(ngrams(t, orders)) if has_letter(t) else 0 for t in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["h", "lang", "n"])

        return each

    def sets():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([ngrams(t, orders).tobytes() for t in batch.column(2).to_pylist()], pa.binary())], ["h", "keys"])

        return each

    hashed = sample.select(F.xxhash64("id", "text", "lang").alias("h"), "lang", "text")
    facts = sorted({(r["h"], r["lang"], r["n"]) for r in map_batches(hashed, sizes, "h long, lang string, n long").collect() if r["n"]})
    short = [f for f in facts if f[2] <= MOST_NGRAMS] or sorted(facts, key=lambda f: f[2])[:landmarks]
    chosen = [short[k][0] for k in turns([f[1] for f in short], landmarks)]
    if not chosen:
        return with_landmarks([], [], orders)
    got = {r["h"]: r["keys"] for r in map_batches(hashed.where(F.col("h").isin(chosen)), sets, "h long, keys binary").collect()}
    model = with_landmarks([np.frombuffer(got[h], dtype=np.uint64) for h in chosen], sorted({f[1] for f in facts}), orders)

    def kernels():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(2).to_pylist()
            rows = np.vstack([model.kernel(texts[at : at + ROWS]) for at in range(0, len(texts), ROWS)])
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(rows), pa.list_(pa.float64()))], ["h", "lang", "row"])

        return each

    there = {f[0] for f in facts}
    rows = sorted((r["h"], r["lang"], r["row"]) for r in map_batches(hashed, kernels, "h long, lang string, row array<double>").collect() if r["h"] in there)
    release(sample)
    return fit_kernel(model, np.array([r[2] for r in rows]), [r[1] for r in rows], ridge)


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for each row of ``docs``; ``und`` and 0 for null texts and those without a letter.

    Whole texts are read, however long. Rows repeat as they come, equal texts get equal results; no rows give no rows. Other
    columns of ``docs`` are ignored, whatever their names.
    """
    kind = dict(docs.dtypes)[id_col]
    kind = kind if kind in ("bigint", "int", "string") else "string"

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores = model.predict(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

        return each

    rows = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, make, f"doc_id {kind}, lang_pred string, score double")
