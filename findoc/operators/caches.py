"""Caches as relations and replays: key expressions, expiry, nearest entry, traces with a capacity and a policy."""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findoc.operators import dense
from findoc.session import written


def normalize_query(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def query_key(text: Column, *filters: Column, k: int = 5, alpha: float = 0.5) -> Column:
    """A digest of the normalised question and everything that changes its answer."""
    return F.sha2(F.concat_ws("|", normalize_query(text), *[F.coalesce(f.cast("string"), F.lit("")) for f in filters], F.lit(str(k)), F.lit(f"{alpha:.2f}")), 256)


def ttl_hits(requests: DataFrame, ttl_s: float) -> DataFrame:
    """(key, ts, seq) with ``hit``: whether the key was put at most ``ttl_s`` ago. A miss puts it again, a hit does not.

    Within a key, requests go in order; each is its own fold, so keys spread over all tasks.
    """

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, put = None, None
        for rows in batches:
            hit = []
            for k, t in zip(rows["key"], rows["t"], strict=True):
                if k != key:
                    key, put = k, None
                fresh = put is not None and t - put <= ttl_s
                put = put if fresh else t
                hit.append(fresh)
            yield rows.assign(hit=hit)[["key", "seq", "hit"]]

    rows = requests.select("key", "seq", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("micros")).select("key", "seq", (F.col("micros") / 1e6).alias("t"))
    kind = dict(requests.dtypes)
    # rows of a key follow each other in one task, in order, and stream through it: no key is gathered in memory
    return rows.repartition("key").sortWithinPartitions("key", "t", "seq").mapInPandas(replay, f"key {kind['key']}, seq {kind['seq']}, hit boolean")


class Cache:
    """Entries of one cache as a trace goes by: at most ``capacity``, each fresh for ``ttl_s`` seconds from when it was put.

    A hit touches its entry. A put of a key that is there updates it in place; a put into a full cache first drops what has
    expired, and only if it is still full the victim of the policy: the least recently used, the least often used (of these
    the least recently) or the first that was put.
    """

    def __init__(self, capacity: int, policy: str, ttl_s: float | None, threshold: float | None):
        self.capacity, self.policy, self.ttl_s, self.threshold = max(1, capacity), policy, ttl_s, threshold
        self.entries: OrderedDict = OrderedDict()  # key: [last use, uses, when put]; the least recently used (lru) or first put comes first
        self.vectors: dict = {}
        self.heap: list[tuple] = []  # (uses, last use, key) of lfu; what no longer agrees with an entry is stale
        self.clock = 0

    def _drop(self, key) -> None:
        del self.entries[key]
        self.vectors.pop(key, None)

    def _touch(self, key) -> None:
        entry = self.entries[key]
        entry[0], entry[1] = self.clock, entry[1] + 1
        if self.policy == "lru":
            self.entries.move_to_end(key)
        elif self.policy == "lfu":
            heapq.heappush(self.heap, (entry[1], entry[0], key))

    def _old(self, entry: list, now: float) -> bool:
        return self.ttl_s is not None and now - entry[2] > self.ttl_s

    def _near(self, vector) -> tuple[float, object]:
        """The greatest cosine of the entries with a vector, and its key; the first put wins a tie."""
        if not self.vectors or vector is None:
            return 0.0, None
        keys = [k for k in self.entries if k in self.vectors]
        if self.policy == "lru":
            keys.sort(key=lambda k: self.entries[k][2])
        own, others = np.asarray(vector, dtype=np.float64), np.array([self.vectors[k] for k in keys])
        both = np.linalg.norm(own) * np.linalg.norm(others, axis=1)
        scores = np.where(both < 1e-14, 0.0, (others @ own) / np.where(both > 0, both, 1))
        best = int(scores.argmax())
        return float(np.clip(scores[best], -1, 1)), keys[best]

    def get(self, key, now: float, vector=None) -> tuple[str, float, object]:
        """(exact, semantic or none, similarity, the entry's key)"""
        self.clock += 1
        if key in self.entries:
            if not self._old(self.entries[key], now):
                self._touch(key)
                return "exact", 1.0, key
            self._drop(key)
        if self.threshold is not None:
            for k in [k for k, e in self.entries.items() if self._old(e, now)]:
                self._drop(k)
            similarity, near = self._near(vector)
            if near is not None and similarity >= self.threshold:
                self._touch(near)
                return "semantic", similarity, near
            return "none", max(0.0, similarity), None
        return "none", 0.0, None

    def put(self, key, now: float, vector=None):
        """The key that had to go, if any."""
        gone = None
        if key in self.entries:
            self._touch(key)
        else:
            if len(self.entries) >= self.capacity:
                for k in [k for k, e in self.entries.items() if self._old(e, now)]:
                    self._drop(k)
            if len(self.entries) >= self.capacity:
                gone = self._victim()
                self._drop(gone)
            self.entries[key] = [self.clock, 1, now]
            if self.policy == "lfu":
                heapq.heappush(self.heap, (1, self.clock, key))
        if vector is not None:
            self.vectors[key] = vector
        return gone

    def _victim(self):
        if self.policy != "lfu":
            return next(iter(self.entries))
        while True:
            uses, used, key = heapq.heappop(self.heap)
            if key in self.entries and self.entries[key][:2] == [used, uses]:
                return key


def replay(requests: DataFrame, capacity: int, policy: str = "lru", ttl_s: float | None = None, threshold: float | None = None) -> DataFrame:
    """(cache_id, seq, key[, ts][, vector]) with hit, hit_type, similarity, entry (the key that answers) and evicted.

    Each cache replays its own trace in order of ``seq``: a request gets, and after a miss puts. With ``ttl_s`` entries
    expire (``ts`` says when a request comes), with ``threshold`` the nearest entry by ``vector`` answers where no key is
    equal. Only one cache's entries are in memory; a trace streams, and caches spread over all tasks. One hot cache is one
    task, for each of its requests depends on all before. Policies: lru, lfu, fifo.
    """
    if policy not in ("lru", "lfu", "fifo"):
        raise ValueError(f"unknown policy {policy!r}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, cache = None, None
        for rows in batches:
            out = []
            for name, key, now, vector in zip(rows["cache_id"], rows["key"], rows["t"], rows["vector"], strict=True):
                if cache is None or name != own:
                    own, cache = name, Cache(capacity, policy, ttl_s, threshold)
                kind, similarity, entry = cache.get(key, now, vector)
                out.append((kind != "none", kind, round(similarity, 4), entry, cache.put(key, now, vector) if kind == "none" else None))
            found = pd.DataFrame(out, columns=["hit", "hit_type", "similarity", "entry", "evicted"], index=rows.index)
            yield pd.concat([rows[["cache_id", "seq", "key"]], found.astype({"entry": object, "evicted": object})], axis=1)

    kind = dict(requests.dtypes)
    t = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) if "ts" in kind else F.lit(0.0)
    vector = F.col("vector").cast("array<double>") if threshold is not None else F.lit(None).cast("array<double>")
    rows = requests.select("cache_id", "seq", "key", t.alias("t"), vector.alias("vector")).repartition("cache_id").sortWithinPartitions("cache_id", "seq")
    return rows.mapInPandas(run, f"cache_id {kind['cache_id']}, seq {kind['seq']}, key {kind['key']}, hit boolean, hit_type string, similarity double, entry {kind['key']}, evicted {kind['key']}")


def follow(requests: DataFrame, front: tuple[int, float], back: tuple[int, float], policy: str = "lru", threshold: float = 0.88) -> DataFrame:
    """(query_id, seq, ts, key, norm, vector) with cache_type, similarity and answered_by, the request whose answer is given.

    The query cache ``front`` (capacity, seconds; least recently used) is asked by ``key`` first, then the semantic cache
    ``back`` by ``norm`` and ``vector``; what neither answers is put into both. With a ``cache_id`` each has its own pair
    of caches; a trace is followed in order, in one task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caches, by, trace = None, None, None
        for rows in batches:
            out = []
            for own, name, key, norm, now, vector in zip(rows["query_id"], rows["cache_id"], rows["key"], rows["norm"], rows["t"], rows["vector"], strict=True):
                if caches is None or name != trace:
                    trace, by = name, ({}, {})
                    caches = Cache(front[0], "lru", front[1], None), Cache(back[0], policy, back[1], threshold)
                kind, similarity, entry = caches[0].get(key, now)
                source = by[0].get(entry)
                if kind == "none":
                    kind, similarity, entry = caches[1].get(norm, now, vector)
                    source = by[1].get(entry)
                if kind == "none":
                    for cache, held, at, v in ((caches[0], by[0], key, None), (caches[1], by[1], norm, vector)):
                        cache.put(at, now, v)
                        held[at] = source = own
                        for gone in [k for k in held if k not in cache.entries] if len(held) > 2 * cache.capacity else []:
                            del held[gone]
                out.append((own, kind, round(float(similarity), 4), source))
            yield pd.DataFrame(out, columns=["query_id", "cache_type", "similarity", "answered_by"])

    kind = dict(requests.dtypes)["query_id"]
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    trace = F.col("cache_id") if "cache_id" in requests.columns else F.lit(0)
    rows = requests.select("query_id", trace.alias("cache_id"), "seq", "key", "norm", t.alias("t"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.repartition("cache_id").sortWithinPartitions("cache_id", "seq")
    return rows.mapInPandas(run, f"query_id {kind}, cache_type string, similarity double, answered_by {kind}")


def lookup(queries: DataFrame, entries: DataFrame, threshold: float = 0.88) -> DataFrame:
    """(query_id, hit_type, similarity, entry_id): exact for an equal normalised text, else the nearest entry at or over ``threshold``.

    ``queries``: (query_id, text, vector); ``entries``: (entry_id, text, vector). Only what has no exact match is compared.
    """
    keyed = entries.select(normalize_query(F.col("text")).alias("norm"), "entry_id").groupBy("norm").agg(F.max("entry_id").alias("entry_id"))
    asked = queries.withColumn("norm", normalize_query(F.col("text")))
    exact = asked.join(keyed, "norm").select("query_id", F.lit("exact").alias("hit_type"), F.lit(1.0).alias("similarity"), "entry_id")
    rest = asked.join(keyed, "norm", "left_anti")
    near = dense.search(entries.select(F.col("entry_id").alias("chunk_id"), "vector"), rest.select("query_id", "vector"), 1)
    near = near.select("query_id", F.when(F.col("score") >= threshold, "semantic").otherwise("none").alias("hit_type"), F.round(F.greatest("score", F.lit(0.0)), 4).alias("similarity"), F.when(F.col("score") >= threshold, F.col("chunk_id")).alias("entry_id"))
    none = rest.select("query_id").join(near.select("query_id"), "query_id", "left_anti").select("query_id", F.lit("none").alias("hit_type"), F.lit(0.0).alias("similarity"), F.lit(None).cast(dict(entries.dtypes)["entry_id"]).alias("entry_id"))
    return exact.unionByName(near).unionByName(none)


def telemetry(events: DataFrame) -> DataFrame:
    """One row: requests, hits, misses, hit_rate of (hit); with hit_type also exact_hits and semantic_hits, with evicted evictions, with latency_ms avg_latency_ms."""
    more = []
    if "hit_type" in events.columns:
        more += [F.count_if(F.col("hit_type") == kind).alias(f"{kind}_hits") for kind in ("exact", "semantic")]
    if "evicted" in events.columns:
        more.append(F.count("evicted").alias("evictions"))
    if "latency_ms" in events.columns:
        more.append(F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 2).alias("avg_latency_ms"))
    return events.agg(F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.coalesce(F.try_divide(F.count_if("hit"), F.count(F.lit(1))), F.lit(0.0)), 4).alias("hit_rate"), *more)


def embedding_misses(texts: DataFrame, cached: DataFrame) -> DataFrame:
    """The distinct (key, text) that a table of embeddings keyed by digest lacks; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return texts.select(F.sha2(text, 256).alias("key"), text.alias("text")).dropDuplicates(["key"]).join(cached.select("key"), "key", "left_anti")


def get_or_compute(texts: DataFrame, cached: DataFrame, compute: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, text) with their vectors, and the cache with what it lacked: each missing text is computed once.

    ``cached`` is (key, vector); ``compute`` maps (key, text) to (key, vector), by default the hashing embedder.
    """
    fresh = embedding_misses(texts, cached)
    made = compute(fresh) if compute else dense.embed(fresh, "key")
    full = written(cached.select("key", "vector").unionByName(made.select("key", "vector")), "embeddings")
    return texts.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256)).join(full, "key").drop("key"), full


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of a key the last."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
