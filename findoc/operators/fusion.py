"""Fusing ranked lists: normalisation, reciprocal ranks, convex blends, metadata filters, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findoc.operators.lexical import ranked


def _one_query():
    return Window.partitionBy("query_id")


def over_fetch(k: int) -> int:
    """Candidates to take from each list before they are fused."""
    return max(4 * k, 30)


def min_max(score: Column, window=None) -> Column:
    """To 0..1 within a query; if all are equal, 1 for positive scores and 0 for others."""
    window = window or _one_query()
    low, high = F.min(score).over(window), F.max(score).over(window)
    return F.when(high - low < 1e-9, F.when(score > 0, 1.0).otherwise(0.0)).otherwise((score - low) / (high - low))


def z_score(score: Column, window=None) -> Column:
    """Mean 0 and sample deviation 1 within a query; 0 if all are equal."""
    window = window or _one_query()
    spread = F.coalesce(F.stddev_samp(score).over(window), F.lit(0.0))
    return F.when(spread < 1e-9, 0.0).otherwise((score - F.avg(score).over(window)) / spread)


def reciprocal_rank(lists: list[DataFrame], k: int = 60, weights: list[float] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, first, scores): sums of weight / (k + rank).

    ``first`` says in which list a chunk stands and where, for ties; ``scores`` maps each list's number to its score there.
    """
    weights = [*(weights or []), *[1.0] * len(lists)][: len(lists)]
    parts = [x.select("query_id", "chunk_id", (F.lit(float(w)) / (k + F.col("rank"))).alias("part"), F.struct(F.lit(n).alias("list"), F.col("rank")).alias("at"), F.struct(F.lit(n).alias("list"), F.col("score").cast("double").alias("score")).alias("own")) for n, (x, w) in enumerate(zip(lists, weights, strict=True))]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"), F.min("at").alias("first"), F.map_from_entries(F.collect_set("own")).alias("scores"))


def allowed(chunks: DataFrame, ticker: str | None = None, period: str | None = None, year: int | None = None, doc_type: str | None = None, modal_type: str | None = None, statement_type: str | None = None) -> DataFrame:
    """The chunks that pass all given filters. Unknown tickers, periods and years pass; modality, statement and document type must match.

    A chunk without a document (null doc_type) passes every document filter.
    """
    keep = F.lit(True)
    if modal_type:
        keep &= F.col("modal_type").eqNullSafe(modal_type)
    if statement_type:
        keep &= F.col("statement_type").eqNullSafe(statement_type)
    for name, value in (("ticker", ticker), ("period", period)):
        if value:
            keep &= F.col(name).isNull() | (F.col(name) == "") | (F.upper(name) == value.upper())
    if year:
        keep &= F.col("year").isNull() | (F.col("year") == year)
    if doc_type:
        keep &= F.col("doc_type").isNull() | (F.lower("doc_type") == doc_type.lower())
    return chunks.where(keep)


def matching(hits: DataFrame, queries: DataFrame, metadata: DataFrame) -> DataFrame:
    """``hits`` whose chunk passes its query's own filters (ticker, period, year, doc_type), renumbered. A null filter passes all.

    ``metadata`` (chunk_id and these four) may lack a chunk; what is unknown of ticker, period and year passes, and a chunk
    without a document passes all.
    """
    asked = queries.select("query_id", *[F.col(c).alias(f"_{c}") for c in ("ticker", "period", "year", "doc_type")])
    known = metadata.select("chunk_id", "ticker", "period", "year", "doc_type")
    rows = hits.join(asked, "query_id").join(known, "chunk_id", "left")
    keep = F.lit(True)
    for c in ("ticker", "period"):
        keep &= F.col(f"_{c}").isNull() | F.col(c).isNull() | (F.col(c) == "") | (F.upper(c) == F.upper(f"_{c}"))
    keep &= F.col("_year").isNull() | F.col("year").isNull() | (F.col("year") == F.col("_year"))
    keep &= F.col("_doc_type").isNull() | F.col("doc_type").isNull() | (F.lower("doc_type") == F.lower("_doc_type"))
    return renumbered(rows.where(keep).select(*hits.columns))


STRATEGIES = ("sparse", "dense", "hybrid_rrf", "hybrid_convex")


def resolve_strategy(explicit: str | None = None, use_rrf: bool | None = None, asked: str | None = None, configured: str = "hybrid_rrf") -> str:
    """Which strategy holds: the explicit one, else what ``use_rrf`` says, else the query's own, else the configured one."""
    by_flag = None if use_rrf is None else "hybrid_rrf" if use_rrf else "hybrid_convex"
    found = explicit or by_flag or asked or configured
    if found not in STRATEGIES:
        raise ValueError(f"unknown strategy {found!r}")
    return found


def renumbered(hits: DataFrame) -> DataFrame:
    """Ranks 1, 2, ... again after rows have gone."""
    return hits.withColumn("rank", F.row_number().over(_one_query().orderBy("rank")))


def retrieve(strategy: str, sparse: DataFrame | None, dense: DataFrame | None, k: int, alpha: float = 0.5, rrf_k: int = 60, allow: DataFrame | None = None, threshold: float = 0.0) -> DataFrame:
    """(query_id, chunk_id, score, dense_score, sparse_score, rank) of the best ``k``.

    ``sparse`` and ``dense`` are ranked candidates, over-fetched by the caller. ``allow`` (chunk_id) filters them after
    the over-fetch; to filter before, search an index of the allowed chunks.
    """
    if allow is not None:
        keep = lambda hits: None if hits is None else renumbered(hits.join(allow.select("chunk_id").distinct(), "chunk_id", "left_semi"))
        sparse, dense = keep(sparse), keep(dense)
    if strategy == "sparse":
        out = sparse.withColumns({"sparse_score": F.col("score"), "dense_score": F.lit(0.0)}).withColumn("score", min_max(F.col("sparse_score"))).withColumn("first", F.col("rank"))
    elif strategy == "dense":
        out = dense.withColumns({"dense_score": F.col("score"), "sparse_score": F.lit(0.0), "first": F.col("rank")})
    else:
        d, s = dense.select("query_id", "chunk_id", F.col("score").alias("dense_score")), sparse.select("query_id", "chunk_id", F.col("score").alias("sparse_score"))
        if strategy == "hybrid_rrf":
            fused = reciprocal_rank([dense, sparse], rrf_k)
            out = fused.withColumns({"dense_score": F.try_element_at("scores", F.lit(0)), "sparse_score": F.try_element_at("scores", F.lit(1))}).drop("scores")
        elif strategy == "hybrid_convex":
            out = d.join(s, ["query_id", "chunk_id"], "full_outer").withColumn("first", F.col("chunk_id"))
        else:
            raise ValueError(f"unknown strategy {strategy!r}")
        out = out.withColumns({"dense_score": F.coalesce("dense_score", F.lit(0.0)), "sparse_score": F.coalesce("sparse_score", F.lit(0.0))})
        if strategy == "hybrid_convex":
            out = out.withColumn("score", alpha * min_max(F.col("dense_score")) + (1.0 - alpha) * min_max(F.col("sparse_score")))
    out = out.withColumns({"score": F.round("score", 6), "dense_score": F.round("dense_score", 4), "sparse_score": F.round("sparse_score", 4)})
    if threshold > 0:
        out = out.where(F.col("score") >= threshold)
    return ranked(out.drop("rank"), k, tie="first").drop("first")


def evaluate(hits: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """One row: recall_at_1, recall_at_k, mrr, ndcg over all of ``queries`` (query_id), query_count.

    ``hits`` is (query_id, chunk_id, rank), ``relevant`` (query_id, chunk_id). No queries give zeros.
    """
    known = relevant.select("query_id", "chunk_id").distinct()
    n_relevant = known.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    good = hits.where(F.col("rank") <= k).join(known, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("top"), F.count(F.lit(1)).alias("hit"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    every = queries.select("query_id").distinct().join(n_relevant, "query_id", "left").join(good, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.coalesce("n", F.lit(0)), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return every.agg(
        mean(F.when(F.col("top") == 1, 1.0).otherwise(0.0)).alias("recall_at_1"),
        mean(F.coalesce(F.col("hit") / F.greatest(F.col("n"), F.lit(1)), F.lit(0.0))).alias("recall_at_k"),
        mean(F.coalesce(1.0 / F.col("top"), F.lit(0.0))).alias("mrr"),
        mean(F.coalesce(F.col("dcg") / ideal, F.lit(0.0))).alias("ndcg"),
        F.count(F.lit(1)).alias("query_count"),
    )
