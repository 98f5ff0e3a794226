"""BM25 as relations: postings (term, chunk), document lengths, term statistics and one row of corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findoc.functions.tokens import lexical_tokens
from findoc.session import written

IDF_FLOOR = 1e-4


@dataclass
class LexicalIndex:
    """``lengths``: (chunk_id, dl) for every chunk; ``postings``: (chunk_id, dl, term, tf).

    ``tokens``: (chunk_id, tokens) where the other two still start from texts; ``kept`` writes them once.
    """

    lengths: DataFrame
    postings: DataFrame
    k1: float = 1.5
    b: float = 0.75
    tokens: DataFrame | None = None

    def kept(self) -> LexicalIndex:
        """The index over its tokens in the shared folder, so that however often it is read no text is tokenised again."""
        return self if self.tokens is None else _over(written(self.tokens, "tokens"), self.k1, self.b)

    @property
    def corpus(self) -> DataFrame:
        """One row: n, avgdl (0 for no chunks)."""
        return self.lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))

    def with_idf(self, frequencies: DataFrame) -> DataFrame:
        """(term, df) with idf."""
        idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0), F.lit(IDF_FLOOR))
        return frequencies.crossJoin(F.broadcast(self.corpus)).withColumn("idf", idf)

    @property
    def term_stats(self) -> DataFrame:
        """(term, df, idf)"""
        return self.with_idf(self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))).select("term", "df", "idf")

    def statistics(self) -> DataFrame:
        """corpus_size, vocabulary_size, avg_document_length, k1, b"""
        vocabulary = self.postings.select("term").distinct().agg(F.count(F.lit(1)).alias("vocabulary_size"))
        both = self.corpus.crossJoin(vocabulary)  # one row each
        return both.select(F.col("n").alias("corpus_size"), "vocabulary_size", F.round("avgdl", 2).alias("avg_document_length"), F.lit(self.k1).alias("k1"), F.lit(self.b).alias("b"))

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, chunk_id, score) over all matching chunks; a query's repeated terms count as often as they come."""
        asked, index = query_terms(queries), self.kept()
        # postings of terms that nobody asks for go before they are grouped
        postings = index.postings.join(asked.select("term").distinct(), "term", "left_semi")
        stats = index.with_idf(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        weighed = asked.join(stats, "term")
        tf, dl = F.col("tf"), F.col("dl")
        weight = F.col("idf") * tf * (self.k1 + 1.0) / (tf + self.k1 * (1.0 - self.b + self.b * dl / F.col("avgdl")))
        return postings.join(weighed, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("qtf") * weight).alias("score"))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, chunk_id, score, rank): positive scores only; equal scores rank by chunk_id."""
        return ranked(self.scores(queries).where("score > 0"), k)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of (query_id, text)."""
    return queries.select("query_id", F.explode(lexical_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def ranked(scored: DataFrame, k: int | None, by: str = "score", tie: str = "chunk_id") -> DataFrame:
    """Rank within query_id by the score rounded to 6 places, then ``tie``; the best ``k`` if given."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(by, 6).desc(), tie))
    out = scored.withColumn("rank", rank)
    return out if k is None else out.where(F.col("rank") <= k)


def fit(chunks: DataFrame, k1: float = 1.5, b: float = 0.75) -> LexicalIndex:
    """Index (chunk_id, text). Null and empty texts have length 0."""
    tokens = chunks.select("chunk_id", lexical_tokens(F.col("text")).alias("tokens"))
    index = _over(tokens, k1, b)
    index.tokens = tokens
    return index


def _over(tokens: DataFrame, k1: float, b: float) -> LexicalIndex:
    sized = tokens.withColumn("dl", F.size("tokens"))
    terms = sized.select("chunk_id", "dl", F.explode("tokens").alias("term"))
    return LexicalIndex(sized.select("chunk_id", "dl"), terms.groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")), k1, b)


def upsert(chunks: DataFrame, more: DataFrame, k1: float = 1.5, b: float = 0.75) -> LexicalIndex:
    """Chunks whose id comes again are replaced, others are added; statistics follow from what then is there."""
    return fit(chunks.join(more.select("chunk_id"), "chunk_id", "left_anti").unionByName(more), k1, b)


def term_frequency(index: LexicalIndex, asked: DataFrame) -> DataFrame:
    """(chunk_id, term, tf) for each asked (chunk_id, term), 0 where there is none; terms are lower-cased."""
    asked = asked.select("chunk_id", F.lower("term").alias("term"))
    return asked.join(index.postings.select("chunk_id", "term", "tf"), ["chunk_id", "term"], "left").select("chunk_id", "term", F.coalesce("tf", F.lit(0)).cast("long").alias("tf"))
