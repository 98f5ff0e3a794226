"""Documents that keep coming: a file stream that is parsed and appended, term statistics that follow, caches with expiry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from findoc.functions.tokens import lexical_tokens
from findoc.operators.parse import chunk_documents, words


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string", files: int = 64) -> DataFrame:
    """New Parquet files of documents, at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _marked(own: int) -> Callable[[Column], Column]:
    return lambda t: F.struct(t.alias("term"), F.lit(own).alias("own"))


def index_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, size: int = 500, overlap: int = 100) -> StreamingQuery:
    """Parse and tokenise each batch into ``path``: chunks, and postings with the batch's number.

    A posting's ``own`` counts what the chunk's next window does not repeat, so own counts add up to the documents'. A
    batch that runs again replaces what it wrote before, so nothing is counted twice after a failure.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunks = chunk_documents(batch, size, overlap).drop("metrics")
        chunks.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
        window, step = F.col("start_idx").isNotNull(), size - overlap
        own = F.when(window, F.array_join(F.slice(words(F.col("content")), 1, step), " ")).otherwise(F.col("content"))
        again = F.when(window, F.array_join(F.slice(words(F.col("content")), step + 1, overlap), " ")).otherwise("")
        found = F.concat(*[F.transform(lexical_tokens(text), _marked(n)) for text, n in ((own, 1), (again, 0))])
        terms = chunks.select("chunk_id", F.explode(found).alias("t")).select("chunk_id", "t.*")
        terms.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.sum("own").alias("own")).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def posting_counts(spark: SparkSession, path: str) -> DataFrame:
    """(term, tf) over the postings that ``index_stream`` wrote, the overlap of windows counted once."""
    return spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum("own").alias("tf")).where("tf > 0")


def term_counts(stream: DataFrame) -> DataFrame:
    """(term, tf) over everything that has come: a running aggregation for the memory or update sinks."""
    return stream.select(F.explode(lexical_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))


def cached_answers(requests: DataFrame, ttl_s: float, late_s: float = 0) -> DataFrame:
    """(key, ts, hit) of a stream of (key, ts): each key's entry is state that expires ``ttl_s`` after it was put.

    Freshness and expiry both follow ``ts``, so a replay of old requests gives what the first run gave. Requests may come
    ``late_s`` seconds late.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        put = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        hits = []
        for t in rows["ts"].astype("int64") / 1e9 if str(rows["ts"].dtype) == "datetime64[ns]" else rows["ts"].map(pd.Timestamp.timestamp):
            fresh = put is not None and t - put <= ttl_s
            put = put if fresh else t
            hits.append(fresh)
        state.update((float(put),))
        state.setTimeoutTimestamp(max(int((put + ttl_s) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"], "hit": hits})

    kind = dict(requests.dtypes)
    timed = requests.withWatermark("ts", f"{late_s} seconds")
    return timed.groupBy("key").applyInPandasWithState(follow, f"key {kind['key']}, ts {kind['ts']}, hit boolean", "put double", "append", GroupStateTimeout.EventTimeTimeout)
