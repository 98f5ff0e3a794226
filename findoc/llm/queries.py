"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findoc.llm.common import table


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies over all documents: of equal texts the row with the largest doc_id stays."""
    from findoc.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles have a similarity of 0.75 or more."""
    from findoc.llm.jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 greatest integer products of every twentieth vector with all others."""
    from findoc.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


OP1_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e AS q JOIN e AS c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences of 4,096 tokens."""
    from findoc.llm.packing import pack
    from findoc.llm.tokens import vocabulary

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text, with the corpus-wide verdict on each value. Documents are the repositories, sources their owners."""
    from findoc.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document; labels of the held-out fold are not learned from."""
    from findoc.llm.fitting import fold
    from findoc.llm.quality import score_quality, train_quality

    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document; labels of the held-out fold are not learned from."""
    from findoc.llm.fitting import fold
    from findoc.llm.toxicity import score_toxicity, train_toxicity

    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document, and its ``placed``: pass:shard:position for each time."""
    from findoc.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"))
    placed = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["pass"], d["shard"], d["position"])), ",")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), placed.alias("placed"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; languages of the held-out fold are not learned from."""
    from findoc.llm.fitting import fold
    from findoc.llm.langid import identify_language, train_language

    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs, train_language(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License sentences in every document and the licenses that they state."""
    from findoc.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_secret_scan": op3_secret_scan,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_language_id": op9_language_id,
    "op10_license_scan": op10_license_scan,
}
ORACLES = {"op1_topk_search": OP1_SQL, "op5_exact_dedup": OP5_SQL}
