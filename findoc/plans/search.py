"""Retrieval queries: documents are the chunks, benchmark items the questions; embeddings are ready-made vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findoc.functions.rounding import rounded
from findoc.operators import dense, fusion, lexical, rerank
from findoc.plans.base import query, table

K = 10
FETCH = fusion.over_fetch(K)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, text, modal_type): the modality follows from what a text holds."""
    text = F.coalesce("text", F.lit(""))
    modal = F.when(F.contains(text, F.lit("|")), "table").when(text.rlike("[0-9]"), "metric").otherwise("text")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), text.alias("text"), modal.alias("modal_type"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# -- SQL shared by the checks ---------------------------------------------------------------------------------------

_TOKEN = r"\$?-?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?%?(?:[a-zA-Z])?|[a-zA-Z0-9_\-]+"
_PAREN = r"\(([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?(?:[MBKmbk%])?)\)"


def tokens_sql(name: str, source: str, key: str) -> str:
    return rf"""
{name}_low AS (
  SELECT {key}, lower(t) AS t
  FROM (SELECT {key}, unnest(regexp_extract_all(regexp_replace(coalesce(text, ''), '{_PAREN}', '-\1', 'g'), '{_TOKEN}')) AS t FROM {source})
  WHERE length(t) > 1 OR regexp_full_match(t, '[0-9]')
), {name}_num AS (
  SELECT {key}, CASE WHEN starts_with(t, '$') THEN ltrim(t, '$') WHEN ends_with(t, '%') THEN rtrim(t, '%') ELSE '' END AS t FROM {name}_low
), {name} AS (
  SELECT {key}, t AS term FROM {name}_low
  UNION ALL SELECT {key}, replace(t, ',', '') FROM {name}_low WHERE contains(t, ',')
  UNION ALL SELECT {key}, t FROM {name}_num WHERE t <> ''
  UNION ALL SELECT {key}, replace(t, ',', '') FROM {name}_num WHERE contains(t, ',')
)"""


STATS_SQL = """
lengths AS (SELECT d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN dt t USING (doc_id) GROUP BY d.doc_id),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
stats AS (SELECT term, df, greatest(ln((n - df + 0.5) / (df + 0.5) + 1.0), 1e-4) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus)"""

SPARSE_SQL = f"""{tokens_sql("dt", "documents", "doc_id")}, {tokens_sql("qt", "benchmark", "item_id")}, {STATS_SQL},
asked AS (SELECT item_id, term, count(*) AS qtf FROM qt GROUP BY ALL),
bm AS (
  SELECT item_id AS query_id, doc_id AS chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM asked JOIN stats USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), corpus GROUP BY ALL
),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM bm WHERE score > 0) WHERE rank <= {FETCH})"""

_WEIGHTS = " ".join(f"WHEN '{w}' THEN {v}" for w, v in dense.CONCEPT_WEIGHTS.items())


def embed_sql(name: str, source: str, key: str) -> str:
    """(key, bucket, value) of hashed and normalised texts; crc32 is worked out with a table of 256 remainders."""
    return f"""
{name}_words AS (SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest(regexp_split_to_array(lower(coalesce(text, '')), '\\s+')) AS w FROM {source}) WHERE w <> '' GROUP BY ALL),
{name}_kept AS (SELECT {key}, regexp_replace(w, '[^\\p{{L}}\\p{{N}}%$]', '', 'g') AS kept, sum(n) AS n FROM {name}_words GROUP BY ALL),
{name}_grams AS (
  SELECT {key}, kept, n, 2.0 AS share, kept AS gram FROM {name}_kept WHERE kept <> ''
  UNION ALL SELECT {key}, kept, n, 1.0, unnest(list_transform(range(1, length(kept) - 1), lambda k: substr(kept, k, 3))) FROM {name}_kept WHERE length(kept) >= 3
),
{name}_table AS (
  SELECT list(c ORDER BY i) AS remainders
  FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS r(i))
),
{name}_bytes AS (
  SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM {name}_grams)
),
{name}_crc AS (
  SELECT gram, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)),
         lambda c, b: xor(c // 256, remainders[xor(c, b) % 256 + 1])), 4294967295::BIGINT) AS crc
  FROM {name}_bytes, {name}_table
),
{name}_raw AS (
  SELECT {key}, (crc % 128)::INTEGER AS bucket, sum(n * share * (CASE kept {_WEIGHTS} ELSE 1.0 END) * (CASE WHEN (crc // 65536) % 2 = 0 THEN 1 ELSE -1 END))::DOUBLE AS x
  FROM {name}_grams JOIN {name}_crc USING (gram) GROUP BY ALL
),
{name} AS (SELECT {key}, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS value FROM {name}_raw WHERE abs(x) > 1e-9)"""


DENSE_SQL = f"""{embed_sql("de", "documents", "doc_id")}, {embed_sql("qe", "benchmark", "item_id")},
products AS (SELECT q.item_id AS query_id, d.doc_id AS chunk_id, sum(q.value * d.value) AS score FROM qe q JOIN de d USING (bucket) GROUP BY ALL),
cosines AS (
  SELECT q.item_id AS query_id, d.doc_id AS chunk_id, round(coalesce(p.score, 0.0), 6) AS score
  FROM benchmark q CROSS JOIN documents d LEFT JOIN products p ON p.query_id = q.item_id AND p.chunk_id = d.doc_id
),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cosines) WHERE rank <= {FETCH})"""


def min_max_sql(column: str) -> str:
    low, high = f"min({column}) OVER (PARTITION BY query_id)", f"max({column}) OVER (PARTITION BY query_id)"
    return f"CASE WHEN {high} - {low} < 1e-9 THEN CASE WHEN {column} > 0 THEN 1.0 ELSE 0.0 END ELSE ({column} - {low}) / ({high} - {low}) END"


# -- lexical --------------------------------------------------------------------------------------------------------


@query("tokenize_tf", f"WITH {tokens_sql('dt', 'documents', 'doc_id')} SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL")
def tokenize_tf(spark, sf_dir):
    index = lexical.fit(chunks(spark, sf_dir))
    return index.postings.select(F.col("chunk_id").alias("doc_id"), "term", "tf")


@query("bm25_term_stats", f"WITH {tokens_sql('dt', 'documents', 'doc_id')}, {STATS_SQL} SELECT term, df, round(idf, 6) AS idf FROM stats")
def bm25_term_stats(spark, sf_dir):
    return lexical.fit(chunks(spark, sf_dir)).term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_corpus_stats", f"WITH {tokens_sql('dt', 'documents', 'doc_id')}, {STATS_SQL} SELECT n AS corpus_size, (SELECT count(*) FROM stats) AS vocabulary_size, round(avgdl, 2) AS avg_document_length, 1.5::DOUBLE AS k1, 0.75::DOUBLE AS b FROM corpus")
def bm25_corpus_stats(spark, sf_dir):
    return lexical.fit(chunks(spark, sf_dir)).statistics()


@query("bm25_topk", f"WITH {SPARSE_SQL} SELECT query_id, chunk_id, round(score, 5) AS score, rank::INTEGER AS rank FROM sparse WHERE rank <= {K}")
def bm25_topk(spark, sf_dir):
    hits = lexical.fit(chunks(spark, sf_dir)).search(questions(spark, sf_dir), K)
    return hits.select("query_id", "chunk_id", F.round("score", 5).alias("score"), "rank")


_UPSERTED = "(SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT item_id AS doc_id, text FROM benchmark)"


@query("bm25_upsert", f"WITH {tokens_sql('dt', _UPSERTED, 'doc_id')}, {STATS_SQL.replace('FROM documents d', 'FROM ' + _UPSERTED + ' d')} SELECT term, df, round(idf, 6) AS idf FROM stats")
def bm25_upsert(spark, sf_dir):
    more = questions(spark, sf_dir).withColumnRenamed("query_id", "chunk_id")
    return lexical.upsert(chunks(spark, sf_dir).select("chunk_id", "text"), more).term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    "term_frequency_lookup",
    f"WITH {tokens_sql('dt', 'documents', 'doc_id')}, asked AS (SELECT doc_id, unnest(['the', lower('OF'), 'password', 'no-such-term']) AS term FROM documents) SELECT a.doc_id, a.term, count(t.term) AS tf FROM asked a LEFT JOIN dt t ON t.doc_id = a.doc_id AND t.term = a.term GROUP BY ALL",
)
def term_frequency_lookup(spark, sf_dir):
    every = chunks(spark, sf_dir)
    asked = every.select("chunk_id", F.explode(F.array(*map(F.lit, ("the", "OF", "password", "no-such-term")))).alias("term"))
    return lexical.term_frequency(lexical.fit(every), asked).withColumnRenamed("chunk_id", "doc_id")


# -- dense ----------------------------------------------------------------------------------------------------------

_VECTORS = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_COSINES = f"{_VECTORS}, scored AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label AS ql, c.label AS cl, round(list_inner_product(q.v, c.v) / sqrt(list_inner_product(q.v, q.v)) / sqrt(list_inner_product(c.v, c.v)), 6) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0)"
_TOP = f"{_COSINES}, hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= {K})"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def vector_queries(spark, sf_dir):
    return vectors(spark, sf_dir).where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")


@query("dense_topk", f"WITH {_TOP} SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM hits")
def dense_topk(spark, sf_dir):
    hits = dense.search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), K)
    return hits.select("query_id", "chunk_id", "score", "rank")


@query(
    "retrieval_eval",
    f"""WITH {_TOP}, per AS (
  SELECT q.query_id, min(CASE WHEN h.ql = h.cl THEN h.rank END) AS top, count(CASE WHEN h.ql = h.cl THEN 1 END) AS hit,
         coalesce(sum(CASE WHEN h.ql = h.cl THEN 1.0 / log2(h.rank + 1) END), 0.0) AS dcg, any_value(n.n) AS n
  FROM (SELECT DISTINCT query_id, ql FROM scored) q JOIN (SELECT label, count(*) AS n FROM v GROUP BY label) n ON n.label = q.ql
  LEFT JOIN hits h ON h.query_id = q.query_id AND h.rank <= 5 GROUP BY q.query_id)
SELECT round(avg(CASE WHEN top = 1 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_1, round(avg(hit / n), 4) AS recall_at_k, round(avg(coalesce(1.0 / top, 0.0)), 4) AS mrr,
       round(avg(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1.0 / log2(i + 1)))), 4) AS ndcg, count(*) AS query_count FROM per""",
)
def retrieval_eval(spark, sf_dir):
    asked = vector_queries(spark, sf_dir)
    relevant = asked.select("query_id", "label").join(vectors(spark, sf_dir).select("chunk_id", "label"), "label")
    return fusion.evaluate(dense_topk(spark, sf_dir), relevant, asked, 5)


@query(
    "vector_distance_metrics",
    f"WITH {_VECTORS} SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, round(1 / (1 + list_distance(a.v, b.v)), 6) AS euclidean, round(list_inner_product(a.v, b.v), 6) AS dot FROM v a JOIN v b ON b.vec_id = a.vec_id + 1",
)
def vector_distance_metrics(spark, sf_dir):
    """Each vector with the next one."""
    a = vectors(spark, sf_dir).select(F.col("chunk_id").alias("vec_id"), F.col("vector").alias("a"))
    b = vectors(spark, sf_dir).select((F.col("chunk_id") - 1).alias("vec_id"), F.col("vector").alias("b"))
    x, y = F.col("a"), F.col("b")
    return a.join(b, "vec_id").select("vec_id", F.round(dense.cosine(x, y), 6).alias("cosine"), F.round(dense.euclidean_similarity(x, y), 6).alias("euclidean"), F.round(dense.dot(x, y), 6).alias("dot"))


@query("vector_normalise", f"WITH {_VECTORS} SELECT vec_id, round(list_inner_product(v, v), 4) AS squared_length, list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6)) AS unit FROM v")
def vector_normalise(spark, sf_dir):
    v = F.col("vector")
    return vectors(spark, sf_dir).select(F.col("chunk_id").alias("vec_id"), rounded(dense.dot(v, v), 4).alias("squared_length"), F.transform(dense.normalised(v), lambda x: rounded(x, 6)).alias("unit"))


@query("hash_embed", f"WITH {embed_sql('de', 'documents', 'doc_id')} SELECT doc_id, bucket, round(value, 5) AS value FROM de WHERE round(value, 5) <> 0")
def hash_embed(spark, sf_dir):
    embedded = dense.embed(chunks(spark, sf_dir))
    values = embedded.select(F.col("chunk_id").alias("doc_id"), F.posexplode("vector").alias("bucket", "value"))
    return values.select("doc_id", "bucket", F.round("value", 5).alias("value")).where("value <> 0")


# -- hybrid ---------------------------------------------------------------------------------------------------------


def candidates(spark, sf_dir, k: int = FETCH) -> tuple[DataFrame, DataFrame]:
    """Sparse and dense candidates of every question."""
    every, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    vectors_of_questions = dense.embed(asked, "query_id")
    return lexical.fit(every).search(asked, k), dense.search(dense.embed(every), vectors_of_questions, k)


@query("dense_text_topk", f"WITH {DENSE_SQL} SELECT query_id, chunk_id, round(score, 4) AS score, rank::INTEGER AS rank FROM dense WHERE rank <= {K}")
def dense_text_topk(spark, sf_dir):
    every, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    hits = dense.search(dense.embed(every), dense.embed(asked, "query_id"), K)
    return hits.select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


_OUT = f"SELECT query_id, chunk_id, score, dense_score, sparse_score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM fused) WHERE rank <= {K}"
_COLUMNS = ("query_id", "chunk_id", "score", "dense_score", "sparse_score", "rank")


@query("sparse_minmax", f"WITH {SPARSE_SQL}, fused AS (SELECT query_id, chunk_id, round({min_max_sql('score')}, 6) AS score, 0.0::DOUBLE AS dense_score, round(score, 4) AS sparse_score, rank AS first FROM sparse) {_OUT}")
def sparse_minmax(spark, sf_dir):
    sparse = lexical.fit(chunks(spark, sf_dir)).search(questions(spark, sf_dir), FETCH)
    return fusion.retrieve("sparse", sparse, None, K).select(*_COLUMNS)


@query("sparse_zscore", f"WITH {SPARSE_SQL} SELECT query_id, chunk_id, round(CASE WHEN coalesce(stddev_samp(score) OVER (PARTITION BY query_id), 0) < 1e-9 THEN 0.0 ELSE (score - avg(score) OVER (PARTITION BY query_id)) / stddev_samp(score) OVER (PARTITION BY query_id) END, 5) AS z FROM sparse")
def sparse_zscore(spark, sf_dir):
    sparse = lexical.fit(chunks(spark, sf_dir)).search(questions(spark, sf_dir), FETCH)
    return sparse.select("query_id", "chunk_id", F.round(fusion.z_score(F.col("score")), 5).alias("z"))


def rrf_sql(extra: str = "", weights: tuple[float, float] = (1.0, 1.0)) -> str:
    return f"""lists AS (SELECT query_id, chunk_id, {weights[0]} / (60 + rank) AS part, rank AS place FROM dense {extra} UNION ALL SELECT query_id, chunk_id, {weights[1]} / (60 + rank), 1000 + rank FROM sparse {extra}),
fused AS (
  SELECT l.query_id, l.chunk_id, round(l.score, 6) AS score, round(coalesce(d.score, 0)::DECIMAL(18, 6), 4)::DOUBLE AS dense_score, round(coalesce(s.score, 0), 4) AS sparse_score, first
  FROM (SELECT query_id, chunk_id, sum(part) AS score, min(place) AS first FROM lists GROUP BY ALL) l
  LEFT JOIN dense d USING (query_id, chunk_id) LEFT JOIN sparse s USING (query_id, chunk_id))"""


@query("hybrid_rrf", f"WITH {SPARSE_SQL}, {DENSE_SQL}, {rrf_sql()} {_OUT}")
def hybrid_rrf(spark, sf_dir):
    return fusion.retrieve("hybrid_rrf", *candidates(spark, sf_dir), K).select(*_COLUMNS)


@query(
    "rrf_weighted",
    f"WITH {SPARSE_SQL}, {DENSE_SQL}, {rrf_sql(weights=(0.3, 2.0))} SELECT query_id, chunk_id, score FROM fused",
)
def rrf_weighted(spark, sf_dir):
    sparse, near = candidates(spark, sf_dir)
    return fusion.reciprocal_rank([near, sparse], 60, [0.3, 2.0]).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(
    "convex_blend",
    f"""WITH {SPARSE_SQL}, {DENSE_SQL}, pooled AS (SELECT query_id, chunk_id, coalesce(d.score, 0) AS ds, coalesce(s.score, 0) AS ss FROM dense d FULL JOIN sparse s USING (query_id, chunk_id)),
fused AS (SELECT query_id, chunk_id, round(0.4 * {min_max_sql("ds")} + 0.6 * {min_max_sql("ss")}, 6) AS score, round(ds::DECIMAL(18, 6), 4)::DOUBLE AS dense_score, round(ss, 4) AS sparse_score, chunk_id AS first FROM pooled) {_OUT}""",
)
def convex_blend(spark, sf_dir):
    return fusion.retrieve("hybrid_convex", *candidates(spark, sf_dir), K, alpha=0.4).select(*_COLUMNS)


#: Metadata made from documents: language as ticker, source as period; every seventh ticker is unknown.
_META = "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 7 = 3 THEN NULL ELSE upper(lang) END AS ticker, upper(source) AS period, CAST(2020 + doc_id % 5 AS INT) AS year, CASE WHEN doc_id % 2 = 0 THEN '10-K' ELSE '10-Q' END AS doc_type, CASE WHEN contains(coalesce(text, ''), '|') THEN 'table' WHEN regexp_like(coalesce(text, ''), '[0-9]') THEN 'metric' ELSE 'text' END AS modal_type, CAST(NULL AS STRING) AS statement_type FROM documents"


def metadata(spark, sf_dir):
    return spark.sql(_META.replace("FROM documents", "FROM {docs}"), docs=table(spark, sf_dir, "documents"))


@query("filter_chunks", f"SELECT chunk_id FROM ({_META.replace('regexp_like', 'regexp_matches').replace('STRING', 'VARCHAR')}) WHERE (ticker IS NULL OR ticker = 'EN') AND (year IS NULL OR year = 2022) AND lower(doc_type) = '10-k' AND modal_type = 'text'")
def filter_chunks(spark, sf_dir):
    return fusion.allowed(metadata(spark, sf_dir), ticker="en", year=2022, doc_type="10-k", modal_type="text").select("chunk_id")


_ALLOW = f"allow AS (SELECT chunk_id FROM ({_META.replace('regexp_like', 'regexp_matches').replace('STRING', 'VARCHAR')}) WHERE ticker IS NULL OR ticker = 'EN')"


@query(
    "filtered_retrieval_post",
    f"""WITH {SPARSE_SQL.replace("sparse AS", "sparse_all AS")}, {DENSE_SQL.replace("dense AS", "dense_all AS")}, {_ALLOW},
sparse AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank) FROM sparse_all WHERE chunk_id IN (SELECT chunk_id FROM allow)),
dense AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank) FROM dense_all WHERE chunk_id IN (SELECT chunk_id FROM allow)), {rrf_sql()} {_OUT}""",
)
def filtered_retrieval_post(spark, sf_dir):
    """The filter follows the over-fetch, as a caller of the two-stage search sees it."""
    return fusion.retrieve("hybrid_rrf", *candidates(spark, sf_dir), K, allow=fusion.allowed(metadata(spark, sf_dir), ticker="EN")).select(*_COLUMNS)


@query(
    "filtered_retrieval_pre",
    f"""WITH {_ALLOW}, {SPARSE_SQL.replace("WHERE score > 0)", "WHERE score > 0 AND chunk_id IN (SELECT chunk_id FROM allow))")}, {DENSE_SQL.replace("AS rank FROM cosines)", "AS rank FROM cosines WHERE chunk_id IN (SELECT chunk_id FROM allow))")}, {rrf_sql()} {_OUT}""",
)
def filtered_retrieval_pre(spark, sf_dir):
    """The filter comes before the over-fetch: no allowed chunk is lost to others."""
    every, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    allow = fusion.allowed(metadata(spark, sf_dir), ticker="EN").select("chunk_id")
    scores = lexical.fit(every).scores(asked).where("score > 0").join(allow, "chunk_id", "left_semi")
    sparse = lexical.ranked(scores, FETCH)
    near = dense.search(dense.embed(every.join(allow, "chunk_id", "left_semi")), dense.embed(asked, "query_id"), FETCH)
    return fusion.retrieve("hybrid_rrf", sparse, near, K).select(*_COLUMNS)


@query("score_threshold_topk", f"WITH {SPARSE_SQL}, fused AS (SELECT query_id, chunk_id, round({min_max_sql('score')}, 6) AS score, 0.0::DOUBLE AS dense_score, round(score, 4) AS sparse_score, rank AS first FROM sparse) {_OUT} AND score >= 0.5")
def score_threshold_topk(spark, sf_dir):
    sparse = lexical.fit(chunks(spark, sf_dir)).search(questions(spark, sf_dir), FETCH)
    return fusion.retrieve("sparse", sparse, None, K, threshold=0.5).select(*_COLUMNS)


# -- reranking ------------------------------------------------------------------------------------------------------

_PAIR_WEIGHTS = " ".join(f"WHEN '{w}' THEN {v}" for w, v in rerank.PAIR_WEIGHTS.items())


def _features_sql(name: str, source: str, key: str) -> str:
    return rf"""{name}_t AS (SELECT {key} AS k, coalesce(text, '') AS text, list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9_\$%]+'), lambda t: lower(t)) AS toks FROM {source}),
{name} AS (
  SELECT k, text, list_distinct(toks) AS tokens, list_distinct(list_transform(range(1, len(toks)), lambda i: toks[i] || chr(1) || toks[i + 1])) AS pairs,
    list_distinct(list_transform(regexp_extract_all(text, '\b[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?\b'), lambda n: replace(n, ',', ''))) AS numbers,
    list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9_\-]+')) AS terms, list_distinct(regexp_extract_all(text, '\b(?:20[0-9]{{2}}|19[0-9]{{2}})\b')) AS years,
    list_distinct(list_transform(regexp_extract_all(text, '(?i)\b(?:Q[1-4]|FY|FY[0-9]{{2,4}})\b'), lambda p: upper(p))) AS periods
  FROM {name}_t)"""


_PAIRS_SQL = f"""{_features_sql("qf", "benchmark", "item_id")}, {_features_sql("df", "documents", "doc_id")},
cand AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM fused),
top AS (SELECT * FROM cand WHERE rank <= {FETCH}),
pair AS (
  SELECT c.*, q.text AS q_text, CASE WHEN contains(d.text, '|') THEN 'table' WHEN regexp_matches(d.text, '[0-9]') THEN 'metric' ELSE 'text' END AS modal,
    coalesce(list_sum(list_transform(list_intersect(q.tokens, d.tokens), lambda t: CASE t {_PAIR_WEIGHTS} ELSE 1.0 END)), 0) / nullif(list_sum(list_transform(q.tokens, lambda t: CASE t {_PAIR_WEIGHTS} ELSE 1.0 END)), 0) AS term,
    CASE WHEN len(q.pairs) > 0 THEN len(list_intersect(q.pairs, d.pairs)) / len(q.pairs) ELSE 0 END AS bi,
    CASE WHEN len(q.numbers) > 0 THEN len(list_intersect(q.numbers, d.numbers)) / len(q.numbers) ELSE 0 END AS num,
    len(list_intersect(q.terms, d.terms)) / greatest(len(q.terms), 1) AS lex, len(q.tokens) = 0 OR len(d.tokens) = 0 AS bare,
    CASE WHEN len(list_intersect(q.years, d.years)) > 0 THEN 0.2 ELSE 0 END + CASE WHEN len(list_intersect(q.periods, d.periods)) > 0 THEN 0.2 ELSE 0 END AS entity
  FROM top c JOIN qf q ON q.k = c.query_id JOIN df d ON d.k = c.chunk_id),
scored AS (SELECT *, CASE WHEN bare THEN 0.0 ELSE round(1 / (1 + exp(-greatest(-10, least(10, 2.5 * term + 1.5 * bi + 1.2 * num - 1)))), 4) END AS raw,
  CASE modal WHEN 'table' THEN 0.2 + CASE WHEN regexp_matches(lower(q_text), 'table|compare|margin|statement|breakdown') THEN 0.1 ELSE 0 END WHEN 'metric' THEN 0.25 ELSE 0.0 END AS bonus FROM pair),
blended AS (SELECT *, CASE WHEN max(raw) OVER (PARTITION BY query_id) - min(raw) OVER (PARTITION BY query_id) > 1e-6 THEN (raw - min(raw) OVER (PARTITION BY query_id)) / (max(raw) OVER (PARTITION BY query_id) - min(raw) OVER (PARTITION BY query_id)) ELSE raw END AS ce,
  score + 0.3 * lex + 0.35 * num + entity AS heur FROM scored)"""


def _rerank_sql(final: str, ce: str) -> str:
    return f"""WITH {SPARSE_SQL}, {DENSE_SQL}, {rrf_sql()}, {_PAIRS_SQL}
SELECT query_id, chunk_id, initial_rank::INTEGER AS initial_rank, rank::INTEGER AS rank, score, cross_encoder_score, heuristic_score, modality_bonus FROM (
  SELECT query_id, chunk_id, rank AS initial_rank, row_number() OVER (PARTITION BY query_id ORDER BY round({final}, 6) DESC, rank) AS rank, round({final}, 6)::DOUBLE AS score, {ce} AS cross_encoder_score, round(heur, 4)::DOUBLE AS heuristic_score, round(bonus, 4)::DOUBLE AS modality_bonus FROM blended
) WHERE rank <= {K}"""


def _reranked(spark, sf_dir, strategy: str) -> DataFrame:
    pool = fusion.retrieve("hybrid_rrf", *candidates(spark, sf_dir), FETCH)
    return rerank.rerank(pool, questions(spark, sf_dir), chunks(spark, sf_dir), strategy, K)


_RERANKED = ("query_id", "chunk_id", "initial_rank", "rank", "score", "cross_encoder_score", "heuristic_score", "modality_bonus")


@query("rerank_hybrid", _rerank_sql("0.7 * ce + 0.3 * heur + bonus", "round(ce, 4)::DOUBLE"))
def rerank_hybrid(spark, sf_dir):
    return _reranked(spark, sf_dir, "hybrid").select(*_RERANKED)


@query("rerank_cross_encoder", _rerank_sql("ce + bonus", "round(ce, 4)::DOUBLE"))
def rerank_cross_encoder(spark, sf_dir):
    return _reranked(spark, sf_dir, "cross_encoder").select(*_RERANKED)


@query("rerank_heuristic", _rerank_sql("heur + bonus", "CAST(NULL AS DOUBLE)"))
def rerank_heuristic(spark, sf_dir):
    return _reranked(spark, sf_dir, "heuristic").select(*_RERANKED)


@query(
    "rerank_explain",
    f"""WITH {SPARSE_SQL}, {DENSE_SQL}, {rrf_sql()}, {_PAIRS_SQL}
SELECT query_id, chunk_id, rank::INTEGER AS rank, explanation FROM (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(heur + bonus, 6) DESC, rank) AS rank,
    concat_ws('; ', 'Heuristic score: ' || printf('%.4f', round(heur, 4)::DOUBLE), CASE WHEN lex > 0 THEN 'Lexical overlap: ' || printf('%.2f', round(lex::DECIMAL(18, 12), 2)::DOUBLE) END, CASE WHEN num > 0 THEN 'Numerical match: ' || printf('%.2f', round(num::DECIMAL(18, 12), 2)::DOUBLE) END,
      CASE WHEN modal <> 'text' THEN upper(modal[1]) || modal[2:] || ' modality boost: +' || printf('%.2f', round(bonus::DECIMAL(18, 6), 2)::DOUBLE) END) AS explanation
  FROM blended) WHERE rank <= {K}""",
)
def rerank_explain(spark, sf_dir):
    return _reranked(spark, sf_dir, "heuristic").select("query_id", "chunk_id", "rank", "explanation")
