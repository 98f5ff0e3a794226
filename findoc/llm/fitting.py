"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findoc.llm.common import BATCH_ROWS, written

#: Tasks that read a sample.
TASKS = 8


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def bounded_sample(rows: DataFrame, max_rows: int, id_col: str) -> DataFrame:
    """At most ``max_rows`` of ``rows``, chosen by a hash of the id, so that the same rows give the same sample."""
    n = rows.count()
    if n <= max_rows:
        return rows
    hashed = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(17)), F.lit(1_000_000_000))
    near = rows.where(hashed < int(1e9 * min(1.0, (max_rows + 5 * max_rows**0.5) / n)))
    return near.orderBy(hashed, F.xxhash64(*rows.columns)).limit(max_rows)


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held_out: int, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table (id, text, y) of at most ``max_rows`` labelled documents outside the held-out fold; y is 1 where the label is above 0.

    Rows without a label or an id do not count; a null text is empty. An id that repeats counts once for each of its rows.
    """
    known = labels.where(F.col(label_col).isNotNull() & (fold(F.col(id_col), folds) != held_out)).select(F.col(id_col).alias("known"), (F.col(label_col) > 0).cast("int").alias("y"))
    known = bounded_sample(known, max_rows, "known")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    both = texts.join(F.broadcast(known), F.col("id") == F.col("known")).select("id", "text", "y").limit(max_rows)
    return written(both.repartition(TASKS), "sample", BATCH_ROWS)
