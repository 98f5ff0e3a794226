"""Grounding and audit queries: what assistants say in conversations, against the other turns of the same conversation."""

from __future__ import annotations

from pyspark.sql import functions as F

from findoc.operators import grounding as gr
from findoc.plans.base import query, table

_NUM, _SIGNED = r"\b[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?\b", r"-?\b[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?\b"


def responses(spark, sf_dir):
    """(query_id, text): each assistant turn."""
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", F.coalesce("text", F.lit("")).alias("text"))


def evidence(spark, sf_dir):
    """(query_id, chunk_id, text): the turns before it that are not the assistant's."""
    turns = table(spark, sf_dir, "conversations").where("role <> 'assistant'").select("conv_id", F.col("turn").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))
    return responses(spark, sf_dir).drop("text").join(turns, "conv_id").select("query_id", "chunk_id", "text")


# RE2 ends words at ASCII letters only, so words with other letters go before words are taken
_ASCII = r"regexp_replace(lower({x}), '[A-Za-z0-9_\p{{L}}]*[^\x00-\x7F][A-Za-z0-9_\p{{L}}]*', ' ', 'g')"
_WORDS = rf"list_distinct(regexp_extract_all({_ASCII}, '\b[A-Za-z0-9_\.]+\b'))"
_NUMS = rf"list_distinct(list_transform(regexp_extract_all({{x}}, '{_SIGNED}'), lambda n: replace(n, ',', '')))"
_SQL = rf"""
resp AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant'),
ev AS (SELECT r.query_id, c.turn AS chunk_id, coalesce(c.text, '') AS text FROM resp r JOIN conversations c ON c.conv_id = r.conv_id AND c.role <> 'assistant'),
parts AS (SELECT query_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM resp),
claims AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY k) - 1 AS claim_id, claim
  FROM (SELECT query_id, k, regexp_replace(s, '^\s+|\s+$', '', 'g') AS claim FROM (SELECT query_id, unnest(p) AS s, generate_subscripts(p, 1) AS k FROM parts)) WHERE length(claim) > 10 AND NOT starts_with(claim, '#')),
cb AS (SELECT *, {_WORDS.format(x="claim")} AS w, {_NUMS.replace("{x}", "claim")} AS n FROM claims),
eb AS (SELECT *, {_WORDS.format(x="text")} AS ew, {_NUMS.replace("{x}", "text")} AS en FROM ev),
sc AS (SELECT c.query_id, c.claim_id, e.chunk_id, list_sort(list_intersect(c.n, e.en)) AS matched, regexp_replace(left(e.text, 250), '^\s+|\s+$', '', 'g') AS quote,
  CASE WHEN len(c.n) > 0 THEN 0.4 * len(list_intersect(c.w, e.ew)) / len(c.w) + 0.6 * len(list_intersect(c.n, e.en)) / len(c.n) ELSE len(list_intersect(c.w, e.ew)) / len(c.w) END AS score
  FROM cb c JOIN eb e USING (query_id) WHERE len(c.w) > 0),
hits AS (SELECT *, round(score, 4)::DOUBLE AS confidence, row_number() OVER (PARTITION BY query_id, claim_id ORDER BY round(score, 4) DESC, chunk_id) AS rank FROM sc WHERE score >= 0.25),
cited AS (SELECT query_id, claim_id, max(confidence) AS top, count(*) AS n_citations FROM hits GROUP BY ALL),
src AS (SELECT query_id, string_agg(text, chr(2)) AS s FROM ev GROUP BY ALL),
nums AS (SELECT query_id, claim_id, unnest(regexp_extract_all(claim, '{_NUM}')) AS x FROM claims),
miss AS (SELECT n.query_id, n.claim_id, count(*) AS n_numbers, coalesce(list_sort(list(x) FILTER (s IS NULL OR NOT (contains(s, x) OR contains(replace(s, ',', ''), replace(x, ',', ''))))), []) AS bad FROM nums n LEFT JOIN src USING (query_id) GROUP BY ALL),
j AS (SELECT c.query_id, c.claim_id, c.claim, top, coalesce(n_citations, 0) AS n_citations, coalesce(bad, []) AS bad, greatest(coalesce(n_numbers, 1), 1) AS n_numbers FROM claims c LEFT JOIN cited USING (query_id, claim_id) LEFT JOIN miss USING (query_id, claim_id)),
k AS (SELECT *, CASE WHEN top IS NULL THEN 0.0 WHEN len(bad) > 0 THEN greatest(0.0, top - 0.4 * len(bad) / n_numbers) ELSE top END AS score FROM j),
verdicts AS (SELECT query_id, claim_id, claim, top IS NOT NULL AND score >= 0.6 AS is_supported, round(score, 4)::DOUBLE AS support_score, bad AS unsupported_numbers, n_citations,
  CASE WHEN top IS NULL THEN 'UNSUPPORTED' WHEN len(bad) > 0 THEN CASE WHEN score >= 0.6 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END WHEN score >= 0.6 THEN 'FULLY_SUPPORTED' ELSE 'PARTIALLY_SUPPORTED' END AS status FROM k)"""


@query("ground_claims", f"WITH {_SQL} SELECT query_id, claim_id::INTEGER AS claim_id, chunk_id, confidence, array_to_string(matched, ',') AS matched_numbers, quote, rank::INTEGER AS rank FROM hits")
def ground_claims(spark, sf_dir):
    hits = gr.ground_claims(gr.claims(responses(spark, sf_dir)), evidence(spark, sf_dir))
    return hits.withColumn("matched_numbers", F.array_join("matched_numbers", ","))


@query("provenance_records", f"WITH {_SQL} SELECT 'prov_' || query_id || '_' || claim_id || '_' || chunk_id AS record_id, confidence >= 0.7 AS verified FROM hits")
def provenance_records(spark, sf_dir):
    return gr.provenance(gr.ground_claims(gr.claims(responses(spark, sf_dir)), evidence(spark, sf_dir))).select("record_id", "verified")


def verdicts(spark, sf_dir):
    return gr.verify_claims(gr.claims(responses(spark, sf_dir)), evidence(spark, sf_dir))


@query("verify_claims", f"WITH {_SQL} SELECT query_id, claim_id::INTEGER AS claim_id, claim, is_supported, support_score, status, array_to_string(unsupported_numbers, ',') AS unsupported_numbers, n_citations FROM verdicts")
def verify_claims(spark, sf_dir):
    return verdicts(spark, sf_dir).withColumn("unsupported_numbers", F.array_join("unsupported_numbers", ","))


@query("hallucination_rates", f"WITH {_SQL} SELECT count(*) AS total_claims, count(*) FILTER (is_supported) AS supported_claims, round(avg((NOT is_supported)::INT), 4) AS hallucination_rate, round(avg((status = 'UNSUPPORTED')::INT), 4) AS unsupported_rate, round(avg(support_score), 4) AS avg_support_score FROM verdicts")
def hallucination_rates(spark, sf_dir):
    return gr.hallucination_rates(verdicts(spark, sf_dir))


_PER = """per AS (SELECT query_id, count(*) AS total_claims, count(*) FILTER (is_supported) AS supported_claims, count(*) FILTER (status = 'PARTIALLY_SUPPORTED') AS partially_supported, count(*) FILTER (status = 'UNSUPPORTED') AS unsupported_claims,
  list_sort(list_distinct(flatten(list(unsupported_numbers)))) AS bad, (2 * sum(round(support_score * 10000)::BIGINT) + count(*)) // (2 * count(*)) / 10000.0 AS confidence FROM verdicts GROUP BY query_id),
aud AS (SELECT r.query_id, coalesce(total_claims, 0) AS total_claims, coalesce(supported_claims, 0) AS supported_claims, coalesce(partially_supported, 0) AS partially_supported, coalesce(unsupported_claims, 0) AS unsupported_claims, coalesce(bad, []) AS bad, coalesce(confidence, 0.0) AS confidence,
  CASE WHEN len(coalesce(bad, [])) > 0 OR (coalesce(total_claims, 0) > 0 AND supported_claims = 0) THEN 'FAIL' ELSE 'PASS' END AS status FROM resp r LEFT JOIN per USING (query_id))"""


@query("audit_responses", f"WITH {_SQL}, {_PER} SELECT * EXCLUDE (bad), array_to_string(bad, ',') AS unsupported_numbers FROM aud")
def audit_responses(spark, sf_dir):
    return gr.audit_responses(responses(spark, sf_dir), verdicts(spark, sf_dir)).withColumn("unsupported_numbers", F.array_join("unsupported_numbers", ","))


@query(
    "audit_batch",
    f"""WITH {_SQL}, {_PER}, t AS (SELECT count(*) AS total_queries, sum(total_claims)::BIGINT AS total_claims, sum(supported_claims)::BIGINT AS supported_claims, sum(partially_supported)::BIGINT AS partially_supported, sum(unsupported_claims)::BIGINT AS unsupported_claims,
  round(avg(confidence) + 1e-9, 4) AS mean_confidence, list_sort(list_distinct(flatten(list(bad)))) AS flagged FROM aud)
SELECT * EXCLUDE (flagged), array_to_string(flagged, ',') AS flagged_numbers, round(unsupported_claims / total_claims, 4) AS hallucination_rate,
  CASE WHEN unsupported_claims / total_claims <= 0.05 AND len(flagged) = 0 THEN 'PASS' WHEN unsupported_claims / total_claims <= 0.1 THEN 'WARN' ELSE 'FAIL' END AS compliance_status FROM t""",
)
def audit_batch(spark, sf_dir):
    audited = gr.audit_responses(responses(spark, sf_dir), verdicts(spark, sf_dir))
    return gr.audit_batch(audited).withColumn("flagged_numbers", F.array_join("flagged_numbers", ","))


#: Answers that cite: each assistant turn with marks put in by SQL, the same in both engines.
_CITING = "SELECT conv_id * 1000 + turn AS query_id, concat('See [1] and [9]. ', {text}, ' As [doc_7:p3#0] and [doc_7:p3#none] say 42.') AS text FROM {table} WHERE role = 'assistant'"


@query(
    "explicit_citations",
    rf"""WITH {_SQL}, citing AS ({_CITING.format(text="coalesce(text, '')", table="conversations")}),
sources AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM ev),
spots AS (
  SELECT query_id, text, 'bracket' AS kind, m, k, 'x' AS id FROM (SELECT query_id, text, unnest(regexp_extract_all(text, '\[[0-9]+\]')) AS m, generate_subscripts(regexp_extract_all(text, '\[[0-9]+\]'), 1) AS k FROM citing)
),
b AS (SELECT query_id, k - 1 AS n, regexp_extract(m, '[0-9]+')::INTEGER AS rank, CASE k WHEN 1 THEN 5 WHEN 2 THEN 13 END AS start, m, text FROM spots WHERE k <= 2),
bq AS (SELECT b.query_id, 'bracket' AS kind, b.n, s.chunk_id::VARCHAR AS chunk_id, 0.95::DOUBLE AS confidence, regexp_replace(substr(b.text, greatest(b.start - 100, 1), b.start - greatest(b.start - 100, 1) + length(m) + 100), '^\s+|\s+$', '', 'g') AS quote, s.text AS source FROM b JOIN sources s ON s.query_id = b.query_id AND s.rank = b.rank),
tail AS (SELECT query_id, text, length(text) - length('[doc_7:p3#0] and [doc_7:p3#none] say 42.') AS spot FROM citing),
g AS (SELECT query_id, 0 AS n, '0' AS chunk_id, substr(text, greatest(spot - 119, 1)) AS quote FROM tail UNION ALL SELECT query_id, 1, 'none', substr(text, greatest(spot + 17 - 119, 1)) FROM tail),
gq AS (SELECT g.query_id, 'badge' AS kind, g.n, g.chunk_id, 0.98::DOUBLE AS confidence, regexp_replace(quote, '^\s+|\s+$', '', 'g') AS quote, coalesce(s.text, '') AS source FROM g LEFT JOIN sources s ON s.query_id = g.query_id AND s.chunk_id::VARCHAR = g.chunk_id)
SELECT query_id, kind, n::INTEGER AS n, chunk_id, confidence, quote, array_to_string(list_sort(list_intersect({_NUMS.replace("{x}", "quote")}, {_NUMS.replace("{x}", "source")})), ',') AS matched_numbers FROM (SELECT * FROM bq UNION ALL SELECT * FROM gq)""",
)
def explicit_citations(spark, sf_dir):
    from pyspark.sql import Window

    citing = spark.sql(_CITING.format(text="coalesce(text, '')", table="{t}"), t=table(spark, sf_dir, "conversations"))
    ranked = evidence(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")))
    return gr.explicit_citations(citing, ranked).withColumn("matched_numbers", F.array_join("matched_numbers", ","))
