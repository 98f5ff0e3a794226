"""Dense vectors: a hashing embedder, normalised index rows, top-k search in query blocks, pair similarities."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findoc.operators.lexical import ranked
from findoc.session import written

#: Weights of financial words.
CONCEPT_WEIGHTS = {
    "revenue": 1.5, "sales": 1.4, "income": 1.5, "profit": 1.4, "operating": 1.3, "margin": 1.4, "cash": 1.3, "flow": 1.3,
    "debt": 1.2, "equity": 1.2, "eps": 1.5, "ebitda": 1.5, "capex": 1.3, "asset": 1.2, "liability": 1.2,
}

#: Queries that are sent to every task at once: bounds what is broadcast, however many queries there are.
QUERY_BLOCK = 4096
#: Rows that are embedded or compared at once.
ROWS = 1024


class HashingEmbedder:
    """Words and their character 3-grams are hashed (crc32) to signed buckets; vectors have length 1 (0 for no words)."""

    def __init__(self, dimension: int = 128, remembered: int = 200_000):
        self.dimension, self.remembered = dimension, remembered
        self.known: dict[str, int] = {}  # word: row of the table
        self.table = np.zeros((0, dimension))

    def _word(self, word: str) -> np.ndarray:
        kept = re.sub(r"[^\w%$]|_", "", word)
        weight = CONCEPT_WEIGHTS.get(kept, 1.0)
        out = np.zeros(self.dimension)
        grams = [(kept, 2.0)] if kept else []
        grams += [(kept[k : k + 3], 1.0) for k in range(len(kept) - 2)]
        for gram, share in grams:
            crc = zlib.crc32(gram.encode("utf-8", "replace"))
            out[crc % self.dimension] += (1.0 if (crc >> 16) % 2 == 0 else -1.0) * share * weight
        return out

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for k, text in enumerate(texts):
            counts = Counter((text or "").lower().split())
            if not counts:
                continue
            if len(self.known) + len(counts) > self.remembered:
                self.known.clear()
                self.table = np.zeros((0, self.dimension))
            if new := [w for w in counts if w not in self.known]:
                at = len(self.known)
                if at + len(new) > len(self.table):
                    self.table = np.vstack([self.table[:at], np.zeros((len(new) + at + 1024, self.dimension))])
                for word in new:
                    self.known[word] = at
                    self.table[at] = self._word(word)
                    at += 1
            rows = np.fromiter(map(self.known.__getitem__, counts), dtype=np.int64, count=len(counts))
            out[k] = np.fromiter(counts.values(), dtype=np.float64, count=len(counts)) @ self.table[rows]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(norm > 1e-6, out / np.where(norm > 0, norm, 1), out)


def embed(rows: DataFrame, id_col: str = "chunk_id", text_col: str = "text", make: Callable[[], Callable] = HashingEmbedder) -> DataFrame:
    """(id, vector) of each text. ``make`` gives a function from a list of texts to a matrix; it is called once a task."""
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            model = model or make()
            matrix = np.asarray(model(batch.column(1).to_pylist()), dtype=np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(matrix.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [id_col, "vector"])

    return rows.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {kind}, vector array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Between -1 and 1; 0 if either has (almost) no length."""
    both = norm(a) * norm(b)
    return F.when((norm(a) < 1e-7) | (norm(b) < 1e-7), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), both))))


def euclidean_similarity(a: Column, b: Column) -> Column:
    return 1.0 / (1.0 + F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)))


def normalised(v: Column) -> Column:
    """Length 1; vectors of (almost) no length stay as they are."""
    return F.when(norm(v) > 1e-6, F.transform(v, lambda x: x.cast("double") / norm(v))).otherwise(F.transform(v, lambda x: x.cast("double")))


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, rank) of each query's ``k`` best cosines; equal scores rank by chunk_id.

    ``index`` is (chunk_id, vector), ``queries`` (query_id, vector). A null vector, or one with a null component, takes no
    part; vectors meet only those of their own width. Every query meets every row: queries go out in blocks of QUERY_BLOCK, an
    index that several blocks pass over is written once, and each task keeps its best ``k`` for each query, so what is
    shuffled is k rows a query and task. No rows give no rows.
    """
    chunk_kind, query_kind = dict(index.dtypes)["chunk_id"], dict(queries.dtypes)["query_id"]
    whole = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    index, queries = (df.where(F.coalesce(whole, F.lit(False))).withColumn("vector", F.col("vector").cast("array<double>")) for df in (index, queries))
    queries = written(queries.select("query_id", "vector"), "queries")
    sizes = [(r["width"], r["n"]) for r in queries.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n")).collect()]
    blocks = [(width, part, -(-n // QUERY_BLOCK)) for width, n in sorted(sizes) for part in range(-(-n // QUERY_BLOCK))]
    if len(blocks) > 1:
        index = written(index.select("chunk_id", "vector"), "vectors")
    found = None
    for width, part, parts in blocks:
        block = queries.where((F.size("vector") == width) & (F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part))
        got = block.toArrow()
        ids = got["query_id"].combine_chunks()
        matrix = np.array(got["vector"].to_pylist(), dtype=np.float64).reshape(len(ids), width)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, matrix=matrix) -> Iterator[pa.RecordBatch]:
            if not len(ids):
                return
            length = np.linalg.norm(matrix, axis=1, keepdims=True)
            unit = matrix / np.where(length > 1e-6, length, 1)
            held_ids, held, kind = None, np.zeros((len(unit), 0)), None
            for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
                m = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, matrix.shape[1])
                size = np.linalg.norm(m, axis=1, keepdims=True)
                scores = np.round(unit @ (m / np.where(size > 1e-6, size, 1)).T, 6) + 0.0
                kind = batch.column(0).type
                own = np.array(batch.column(0).to_pylist())
                if held.shape[1] >= k and not (scores.max(axis=1) >= held[:, -1]).any():
                    continue
                every, names = np.hstack([held, scores]), np.broadcast_to(own, scores.shape) if held_ids is None else np.hstack([held_ids, np.broadcast_to(own, scores.shape)])
                best = np.lexsort((names, -every), axis=1)[:, :k]
                held, held_ids = np.take_along_axis(every, best, 1), np.take_along_axis(names, best, 1)
            if held_ids is not None:
                n = held.shape[1]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(unit)), n))), pa.array(held_ids.ravel().tolist(), kind), pa.array(held.ravel())], ["query_id", "chunk_id", "score"])

        here = index.where(F.size("vector") == width).select("chunk_id", "vector").mapInArrow(run, f"query_id {query_kind}, chunk_id {chunk_kind}, score double")
        found = here if found is None else found.unionByName(here)
    if found is None:
        found = index.sparkSession.createDataFrame([], f"query_id {query_kind}, chunk_id {chunk_kind}, score double")
    return ranked(found, k)


def append(index: DataFrame, more: DataFrame) -> DataFrame:
    """``index`` and ``more`` (chunk_id, vector); ids are not made distinct."""
    return index.select("chunk_id", "vector").unionByName(more.select("chunk_id", "vector"))


def upsert(index: DataFrame, more: DataFrame) -> DataFrame:
    """Vectors whose id comes again are replaced, others are added."""
    return append(index.join(more.select("chunk_id"), "chunk_id", "left_anti"), more)


def vectors_of(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(chunk_id, vector) of the asked ids."""
    return index.select("chunk_id", "vector").join(asked.select("chunk_id").distinct(), "chunk_id", "left_semi")


def similarities(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity): the cosine of each pair of ids that are both there."""
    side = lambda name: index.select(F.col("chunk_id").alias(name), F.col("vector").alias(f"{name}_vector"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", F.round(cosine(F.col("a_vector"), F.col("b_vector")), 6).alias("similarity"))
