"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are range-partitioned by length (ties by a hash of the id, so that a vector that many rows share is spread) and
packed into blocks of descending length. Blocks are taken in waves, the longest vectors first and each wave twice the one
before; after a wave every query's best are merged and its k-th is its threshold in the next, so a wave adds about k rows a
query however many blocks it has. A tile is one block and a slice of the queries that it can still matter to. In a block,
buckets of similar length are taken in turn: the query's threshold, divided by its own length and the bucket's greatest, is
a local cosine threshold. Above 1 the bucket is skipped; a high one prunes by coordinates (a vector with that cosine must
have its coordinates near the query's, or between them and the axis), a low one by length (a prefix of the bucket). What is
left is verified with exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findoc.llm.common import release, written

#: Vectors of a block and of a bucket; queries of a block, and blocks of queries in a tile.
BLOCK, BUCKET, QUERIES, SLICE = 8192, 512, 128, 64
#: Local cosine thresholds from here on prune by coordinates, lower ones by length.
BY_COORDINATE = 0.6
#: Coordinates that the pruning looks at: those in which a query is largest.
FOCUS = 2
_SLACK = 1e-9
#: The threshold of a query that has fewer than k yet, and the bounds of a score.
NONE = np.iinfo(np.int64).min
_LOW, _HIGH = -(2**63), 2**63 - 1


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """(dim, longest, n, ids, matrix) blocks of rows (id, v), each task's by descending length and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int, parts: list) -> pa.RecordBatch:
            ids = np.concatenate([p[0] for p in parts])
            m = np.concatenate([p[1] for p in parts])
            norms = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
            order = np.lexsort((ids, -norms))
            columns = [[dim], [float(norms.max(initial=0.0))], [len(ids)], [ids[order].tobytes()], [m[order].tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["dim", "longest", "n", "ids", "matrix"])

        for batch in batches:
            lists = batch.column(1)
            ids, sizes = batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy())
            flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                m = flat[starts[at][:, None] + np.arange(dim)].astype(np.int64).reshape(len(at), dim)
                held.setdefault(int(dim), []).append((ids[at], m))
            for dim in [d for d, parts in held.items() if sum(len(p[0]) for p in parts) >= size]:
                yield out(dim, held.pop(dim))
        for dim, parts in held.items():
            yield out(dim, parts)

    return rows.select("id", "v").mapInArrow(run, "dim int, longest double, n long, ids binary, matrix binary")


def _matrix(ids: bytes, matrix: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, dtype=np.int64)
    return names, np.frombuffer(matrix, dtype=np.int64).reshape(len(names), dim)


class Bucketed:
    """A block of vectors by descending length, in buckets."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray):
        self.ids, self.whole = ids, whole
        self.real = whole.astype(np.float64)
        self.norms = np.sqrt((self.real**2).sum(axis=1))
        self.unit = self.real / np.maximum(self.norms, 1e-300)[:, None]
        self.most = float(np.abs(self.real).max(initial=0.0))

    def products(self, queries: np.ndarray, real: np.ndarray):
        """(pairs, all): functions that give the int64 scores of pairs, and of all of some queries with a range of vectors.

        Sums under 2 ** 52 are exact in doubles, those under 2 ** 62 in 64 bits; beyond that they are worked out without
        bounds and end at the range of a long.
        """
        most = self.most * float(np.abs(real).max(initial=0.0)) * max(1, real.shape[1])
        if most < 2.0**52:
            pairs = lambda q, c: np.rint(np.einsum("ij,ij->i", real[q], self.real[c])).astype(np.int64)
            return pairs, lambda q, at, end: np.rint(real[q] @ self.real[at:end].T).astype(np.int64)
        if most < 2.0**62:
            return lambda q, c: np.einsum("ij,ij->i", queries[q], self.whole[c]), lambda q, at, end: queries[q] @ self.whole[at:end].T
        clipped = lambda x: np.minimum(np.maximum(x, _LOW), _HIGH).astype(np.int64)
        big, own = queries.astype(object), self.whole.astype(object)
        return lambda q, c: clipped((big[q] * own[c]).sum(axis=1)), lambda q, at, end: clipped(big[q] @ own[at:end].T)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, bound: np.ndarray, bound_id: np.ndarray):
        """(query position, score, id): each query's best k here, of those that beat (bound, bound_id)."""
        real = queries.astype(np.float64)
        norm = np.sqrt((real**2).sum(axis=1))
        pairs, every = self.products(queries, real)
        least, bound_id = bound.copy(), bound_id.copy()
        bound = np.where(least == NONE, -np.inf, least.astype(np.float64))
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        unit = real / np.maximum(norm, 1e-300)[:, None]
        focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
        for at in range(0, len(self.ids), BUCKET):
            end = min(at + BUCKET, len(self.ids))
            longest = self.norms[at]
            with np.errstate(divide="ignore", invalid="ignore"):
                local = np.where(norm * longest > 0, bound / (norm * longest), np.where(bound > 0, np.inf, -np.inf))
            active = local <= 1 + _SLACK
            if not active.any():
                if (bound > 0).all():
                    break
                continue
            found = []
            narrow = np.flatnonzero(active & (local >= BY_COORDINATE))
            if len(narrow):
                keep = np.ones((len(narrow), end - at), dtype=bool)
                cos = np.clip(local[narrow], -1, 1)
                for f in range(focus.shape[1]):
                    own = unit[narrow, focus[narrow, f]]
                    spread = np.sqrt(np.maximum((1 - cos**2) * (1 - own**2), 0)) + 1e-7
                    # a query nearer to the axis than the threshold's angle: vectors up to the axis itself qualify
                    low, high = np.where(own <= -cos, -np.inf, own * cos - spread), np.where(own >= cos, np.inf, own * cos + spread)
                    there = self.unit[at:end, focus[narrow, f]].T
                    keep &= (there >= low[:, None]) & (there <= high[:, None])
                q, c = np.nonzero(keep)
                for part in range(0, len(q), 1 << 16):
                    pq, pc = narrow[q[part : part + (1 << 16)]], at + c[part : part + (1 << 16)]
                    found.append((pq, pairs(pq, pc), pc))
            wide = np.flatnonzero(active & (local < BY_COORDINATE))
            if len(wide):
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where((bound[wide] > 0) & (norm[wide] > 0), bound[wide] / norm[wide], 0).min() * (1 - _SLACK)
                stop = at + int(np.searchsorted(-self.norms[at:end], -need, side="right"))
                if stop > at:
                    scores = every(wide, at, stop)
                    q, c = np.nonzero(scores >= least[wide][:, None])
                    found.append((wide[q], scores[q, c], at + c))
            if not found:
                continue
            q, s, c = (np.concatenate([f[k] for f in found]) for k in range(3))
            ids = self.ids[c]
            fit = (ids != query_ids[q]) & ((s > least[q]) | ((s == least[q]) & (ids < bound_id[q])))
            q, s, ids = (np.concatenate([x, y[fit]]) for x, y in zip(best, (q, s, ids), strict=True))
            order = np.lexsort((ids, -s, q))
            q, s, ids = q[order], s[order], ids[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
            last = rank == k - 1
            least[q[last]], bound_id[q[last]] = s[last], ids[last]
            bound[q[last]] = s[last].astype(np.float64)
            best = tuple(x[rank < k] for x in (q, s, ids))
        return best


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component as double; vectors that are null or hold a null or non-finite component are left out."""
    x = F.col("_v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("_v"))
    fit = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.coalesce(fit, F.lit(False))).select("id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


_STATE = "qb long, dim int, ids binary, matrix binary, filled binary, score binary, vec binary"
_KINDS = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
_NAMES = ("qb", "dim", "ids", "matrix", "filled", "score", "vec")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows one by one, so that one block at a time is taken out of Arrow."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _best(row: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many each query of a state row has, and their scores and ids by rank."""
    filled = np.frombuffer(row["filled"], dtype=np.int64)
    return filled, *(np.frombuffer(row[c], dtype=np.int64).reshape(len(filled), k) for c in ("score", "vec"))


def _thresholds(row: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    filled, score, vec = _best(row, k)
    full = filled == k
    return np.where(full, score[:, -1], NONE), np.where(full, vec[:, -1], np.iinfo(np.int64).max)


def _asked(state: DataFrame, wave: dict[int, list[tuple[int, float]]], k: int) -> DataFrame:
    """Query blocks with their thresholds and the vector blocks of the wave (dim: [(key, longest)]) that they still need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, m = _matrix(row["ids"], row["matrix"], row["dim"])
            least, least_id = _thresholds(row, k)
            bound = np.where(least == NONE, -np.inf, least.astype(np.float64))
            norm = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
            wanted = [key for key, longest in wave.get(row["dim"], []) if ((norm * longest * (1 + _SLACK) >= bound) | (bound <= 0)).any()]
            columns = [[row["qb"]], [row["dim"]], [row["ids"]], [row["matrix"]], [least.tobytes()], [least_id.tobytes()], [wanted]]
            kinds = (*_KINDS[:4], pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*_NAMES[:4], "bound", "bound_id", "wanted"])

    return state.mapInArrow(run, "qb long, dim int, ids binary, matrix binary, bound binary, bound_id binary, wanted array<long>")


def _searched(asked: DataFrame, blocks: DataFrame, keys: list[int], slices: int, k: int) -> DataFrame:
    """(qb, at, score, vec_id): what the wave's blocks add to the queries, tile by tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, block = None, None
        for row in _rows(batches):
            ids, m = _matrix(row["ids"], row["matrix"], row["dim"])
            if row["bound"] is None:
                tile, block = (row["key"], row["slice"]), Bucketed(ids, m)
                continue
            if (row["key"], row["slice"]) != tile:
                raise ValueError("a query block came without its vector block")
            at, s, vec = block.search(ids, m, k, *(np.frombuffer(row[c], dtype=np.int64) for c in ("bound", "bound_id")))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["qb"])), pa.array(at), pa.array(s), pa.array(vec)], ["qb", "at", "score", "vec_id"])

    none = F.lit(None)
    theirs = asked.select(F.explode("wanted").alias("key"), F.pmod(F.xxhash64("qb"), F.lit(slices)).alias("slice"), "qb", "dim", "ids", "matrix", "bound", "bound_id")
    tiles = theirs.select("key", "slice").distinct()
    own = blocks.where(F.col("key").isin(keys)) if len(keys) <= 64 else blocks.where(F.col("key").isNotNull())
    own = own.join(tiles, "key").select("key", "slice", none.cast("long").alias("qb"), "dim", "ids", "matrix", none.cast("binary").alias("bound"), none.cast("binary").alias("bound_id"))
    dealt = own.union(theirs).repartition(max(1, len(keys) * slices), "key", "slice").sortWithinPartitions("key", "slice", F.col("bound").isNotNull(), "qb")
    return dealt.mapInArrow(run, "qb long, at long, score long, vec_id long")


def _merged(state: DataFrame, found: DataFrame, blocks: int, k: int) -> DataFrame:
    """The state after a wave: each query block's best of before and of what was found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, q, s, v = None, [], [], []

        def fold() -> None:
            at, score, vec = (np.concatenate(x) for x in (q, s, v))
            order = np.lexsort((vec, -score.astype(np.float64), at)) if np.abs(score.astype(np.float64)).max(initial=0) < 2.0**53 else np.array(sorted(range(len(at)), key=lambda i: (at[i], -int(score[i]), vec[i])), dtype=np.int64)
            at, score, vec = at[order], score[order], vec[order]
            keep = np.arange(len(at)) - np.searchsorted(at, at, side="left") < k
            q[:], s[:], v[:] = [at[keep]], [score[keep]], [vec[keep]]

        def out() -> pa.RecordBatch:
            fold()
            n = len(row["ids"]) // 8
            filled = np.bincount(q[0], minlength=n).astype(np.int64)
            score, vec = np.zeros((n, k), dtype=np.int64), np.zeros((n, k), dtype=np.int64)
            place = np.arange(len(q[0])) - np.searchsorted(q[0], q[0], side="left")
            score[q[0], place], vec[q[0], place] = s[0], v[0]
            values = [row["qb"], row["dim"], row["ids"], row["matrix"], filled.tobytes(), score.tobytes(), vec.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, _KINDS, strict=True)], list(_NAMES))

        for batch in batches:
            first = batch.column(1).is_valid().to_numpy(zero_copy_only=False)  # rows of the state have a dimension
            qb = batch.column(0).to_numpy()
            edges = [0, *np.flatnonzero(first | np.append(False, qb[1:] != qb[:-1])).tolist()]
            for start, end in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                if start == end:
                    continue
                if first[start]:
                    if row is not None:
                        yield out()
                    row = batch.slice(start, 1).to_pylist()[0]
                    filled, score, vec = _best(row, k)
                    there = np.arange(k) < filled[:, None]
                    q, s, v = [np.nonzero(there)[0]], [score[there]], [vec[there]]
                    start += 1
                if start < end:
                    part = batch.slice(start, end - start)
                    for held, name in ((q, "at"), (s, "add"), (v, "vec_id")):
                        held.append(part.column(part.schema.get_field_index(name)).to_numpy())
                    if sum(map(len, q)) > 1 << 18:
                        fold()
        if row is not None:
            yield out()

    extra = {c: F.lit(None).cast("long") for c in ("at", "add", "vec_id")}
    left = state.withColumns(extra)
    right = found.select("qb", *[F.lit(None).cast(t).alias(c) for c, t in zip(_NAMES[1:], ("int", *["binary"] * 5), strict=True)], "at", F.col("score").alias("add"), "vec_id")
    dealt = left.union(right).repartition(max(1, blocks), "qb").sortWithinPartitions("qb", F.col("dim").isNull())
    return dealt.mapInArrow(run, _STATE)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` greatest integer products of each query with every vector of another id: query_id, rank, vec_id, score.

    ``is_query`` is a condition on a column named ``id``. Ties go to the smaller vec_id; fewer than k candidates give all
    of them. Null or non-finite vectors and null ids take no part; vectors meet only those of their own dimension. A
    query that repeats with the same vector counts once, candidates as often as they come. Ids of queries must have one
    vector each. Components and scores beyond the range of a long are its ends. No rows give no rows. Other columns of
    ``vectors`` are ignored, whatever their names.
    """
    rows = quantised(vectors, id_col, vec_col, scale)
    sized = written(rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)), "vectors")
    n = sized.count()
    parts = max(1, -(-n // BLOCK))
    blocks = _pack(sized.repartitionByRange(parts, F.col("norm").desc(), F.xxhash64("id")), BLOCK)
    blocks = written(blocks.withColumn("key", F.monotonically_increasing_id()), "vector-blocks")
    asking = sized.where(is_query).select("id", "v")
    queries = _pack(asking.dropDuplicates(["id", "v"]).coalesce(1 + asking.count() // (16 * QUERIES)), QUERIES)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            size = len(row["ids"]) // 8
            for at in range(0, max(size, 1), QUERIES):
                some = min(QUERIES, size - at)
                values = [row["dim"], row["ids"][8 * at : 8 * (at + some)], row["matrix"][8 * at * row["dim"] : 8 * (at + some) * row["dim"]], bytes(8 * some), bytes(8 * some * k), bytes(8 * some * k)]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, _KINDS[1:], strict=True)], list(_NAMES[1:]))

    state = queries.mapInArrow(start, _STATE.split(", ", 1)[1]).withColumn("qb", F.monotonically_increasing_id()).select(*_NAMES)
    state = written(state, "query-blocks")
    release(sized)
    n_blocks = state.count()
    # one small row a block: 16 bytes for 8,192 vectors
    by_dim: dict[int, list[tuple[float, int]]] = {}
    for r in blocks.select("key", "dim", "longest").collect():
        by_dim.setdefault(r["dim"], []).append((-r["longest"], r["key"]))
    order = {dim: [(key, -longest) for longest, key in sorted(found)] for dim, found in by_dim.items()}
    at, size = 0, 1
    while n_blocks and (wave := {dim: found[at : at + size] for dim, found in order.items() if found[at : at + size]}):
        keys = [key for found in wave.values() for key, _ in found]
        asked = written(_asked(state, wave, k), "asked")
        if not asked.where(F.size("wanted") > 0).limit(1).count():
            release(asked)
            break
        found = written(_searched(asked, blocks, keys, -(-n_blocks // SLICE), k), "found")
        old, state = state, written(_merged(state, found, n_blocks, k), "query-blocks")
        release(asked, found, old)
        at, size = at + size, 2 * size
    release(blocks)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            filled, score, vec = _best(row, k)
            q, place = np.nonzero(np.arange(k) < filled[:, None])
            ids = np.frombuffer(row["ids"], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array((place + 1).astype(np.int32)), pa.array(vec[q, place]), pa.array(score[q, place])], ["query_id", "rank", "vec_id", "score"])

    return state.mapInArrow(ranked, "query_id long, rank int, vec_id long, score long")
