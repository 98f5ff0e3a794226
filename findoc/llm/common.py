"""What the training-data operators share: shared-folder tables, checked broadcasts and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from findoc.session import release, releasing, shared_dir, written

__all__ = ["few", "filter_of", "join_counted", "map_batches", "maybe_in", "passing", "release", "releasing", "shared_dir", "table", "unused", "without", "written"]

#: A key with more than 1 / HOT_SHARE of all rows counts as hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 256

#: Rows of one Arrow batch: bounds what a Python worker holds even when every text is very long.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """``df`` in a task for every ``each`` of about ``rows`` rows, at most as many as it has: small tables need few tasks."""
    return df.coalesce(1 + int(rows) // each)


def join_counted(left: DataFrame, index: DataFrame, key: str, count: str, how: str = "left") -> DataFrame:
    """``left`` joined (left or inner) with ``index``, which has one row of fixed width per ``key`` and in ``count`` how many rows of ``left`` it has.

    Keys with more than 1 / HOT_SHARE of all counted rows are fewer than HOT_SHARE, so they are broadcast; the rest is
    shuffled, where no key is hot.
    """
    total = index.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    least = total / HOT_SHARE
    if total == 0 or index.agg(F.max(count)).first()[0] <= least:
        return left.join(index, key, how)
    hot = index.where(F.col(count) > least)
    cold = index.where(F.col(count) <= least)
    tag = unused([*left.columns, *index.columns], "_hot")
    tagged = left.join(F.broadcast(hot.select(key).withColumn(tag, F.lit(True))), key, "left")
    there = tagged.where(tag).drop(tag).join(F.broadcast(hot), key)
    return there.unionByName(tagged.where(F.col(tag).isNull()).drop(tag).join(cold, key, how))


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    low = {c.lower() for c in columns}
    while name.lower() in low:
        name = f"_{name}"
    return name


#: Bitmaps of a filter, 4 KiB (32,768 bits) each: what is broadcast has a fixed size. Where a filter fills up, more rows pass, which costs work but changes no result.
BUCKETS = 1024


def _hashed(key: str) -> tuple[Column, Column]:
    hashed = F.xxhash64(key)
    return F.pmod(hashed, F.lit(BUCKETS)), F.pmod(F.shiftright(hashed, 20), F.lit(32768))


def filter_of(shared: DataFrame, key: str) -> DataFrame:
    """(bucket, bits): a filter that every ``key`` of ``shared`` passes, and few others."""
    bucket, bit = _hashed(key)
    return shared.select(bucket.alias("bucket"), bit.alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _marked(rows: DataFrame, bitmaps: DataFrame, key: str, mark: str) -> DataFrame:
    """``rows`` with ``mark``: whether ``key`` passes the filter."""
    one, two, three = (unused([*rows.columns, mark], n) for n in ("_bucket", "_bit", "_bits"))
    bucket, bit = _hashed(key)
    byte = F.conv(F.hex(F.substring(three, (F.col(two) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, F.pmod(two, F.lit(8)).cast("int")) == 1, F.lit(False))
    return rows.withColumns({one: bucket, two: bit}).join(F.broadcast(bitmaps.toDF(one, three)), one, "left").select(*rows.columns, there.alias(mark))


def passing(rows: DataFrame, bitmaps: DataFrame, key: str) -> DataFrame:
    mark = unused(rows.columns, "_maybe")
    return _marked(rows, bitmaps, key, mark).where(mark).drop(mark)


def maybe_in(rows: DataFrame, shared: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is in ``shared``, and few others: what is left to shuffle."""
    return passing(rows, filter_of(shared, key), key)


def without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is not in ``dropped``; null keys stay. Only rows that pass the filter are shuffled."""
    dropped = dropped.where(F.col(key).isNotNull()).select(key)
    mark = unused(rows.columns, "_maybe")
    marked = _marked(rows, filter_of(dropped, key), key, mark)
    sure = marked.where(~F.col(mark)).drop(mark)
    return sure.unionByName(marked.where(mark).drop(mark).join(dropped, key, "left_anti"))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Run over Arrow batches, BATCH_ROWS rows at a time; ``make`` runs once a task and returns the batch function.

    Spark bounds the bytes of a batch (spark.sql.execution.arrow.maxBytesPerBatch); no session setting is changed.
    """
    size = BATCH_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = None
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                each = each or make()
                yield each(batch.slice(at, size))

    return df.mapInArrow(run, schema)
