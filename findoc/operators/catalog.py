"""What is there: filings by period and id, with a row for what is missing, and the state of an engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findoc.operators.lexical import LexicalIndex


def by_period(filings: DataFrame, asked: DataFrame) -> DataFrame:
    """(ticker, year, period, doc_id, error) for each row of ``asked``: the filing with the least id, or an error where there is none."""
    keys = ["ticker", "year", "period"]
    first = filings.where(F.col("ticker").isNotNull()).groupBy(*keys).agg(F.min("doc_id").alias("doc_id"))
    missing = F.concat(F.lit("no filing of "), "ticker", F.lit(" for "), F.coalesce("period", F.lit("")), F.lit(" "), F.col("year").cast("string"))
    return asked.select(*keys).distinct().join(first, keys, "left").select(*keys, "doc_id", F.when(F.col("doc_id").isNull(), missing).alias("error"))


def for_ids(results: DataFrame, ids: DataFrame, key: str, what: str) -> DataFrame:
    """``results`` of the asked ids, and a row with an error for each id that has none."""
    found = ids.select(key).distinct().join(results.withColumn("_there", F.lit(True)), key, "left")
    missing = F.concat(F.lit(f"{what} "), F.col(key).cast("string"), F.lit(" is not there"))
    return found.withColumn("error", F.when(F.col("_there").isNull(), missing)).drop("_there")


def status(index: LexicalIndex, chunks: DataFrame, dimension: int = 128, strategy: str = "hybrid_rrf", rrf_k: int = 60, reranker: str | None = "hybrid") -> DataFrame:
    """One row about an engine: total_documents, total_chunks, bm25_vocab_size, bm25_avgdl and what is configured. ``chunks``: (chunk_id, doc_id)."""
    kept = index.kept()
    totals = chunks.agg(F.countDistinct("doc_id").alias("total_documents"))
    numbers = kept.statistics().select(F.col("corpus_size").alias("total_chunks"), F.col("vocabulary_size").alias("bm25_vocab_size"), F.col("avg_document_length").alias("bm25_avgdl"))
    settings = {"vector_dimension": dimension, "strategy": strategy, "rrf_k": rrf_k, "reranker": reranker}
    return totals.crossJoin(numbers).select("*", *[F.lit(v).alias(k) for k, v in settings.items()])  # one row each
