"""Queries over graphs, routes, caches, manifests and documents as files would hold them."""

from __future__ import annotations

from pyspark.sql import functions as F

from findoc.operators import caches, graph, parse, router
from findoc.plans import fixtures as fx
from findoc.plans.base import query, table

# -- routing --------------------------------------------------------------------------------------------------------


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


_INTENT = " ".join(f"WHEN {_has(words)} THEN '{name}'" for name, _, _, words in router.INTENTS)
_MODAL = " ".join(f"WHEN {_has(words)} THEN '{kind}'" for _, kind, _, words in router.INTENTS)
_HOW = " ".join(f"WHEN {_has(words)} THEN '{how}'" for _, _, how, words in router.INTENTS)
_STOP = ", ".join(f"'{w}'" for w in router.NO_TICKERS)


def _route_sql(source: str) -> str:
    return rf"""SELECT query_id, CASE {_INTENT} ELSE 'general' END AS intent, CASE {_MODAL} ELSE 'text' END AS preferred_modal, CASE {_HOW} ELSE 'hybrid' END AS reranker_strategy,
  list_filter(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda t: NOT regexp_matches(t, '[0-9]')), lambda t: regexp_replace(t, '[^A-Za-z]', '', 'g')), lambda t: regexp_full_match(t, '[A-Z]{{1,5}}') AND t NOT IN ({_STOP}))[1] AS ticker,
  upper(nullif(regexp_extract(text, '{router.PERIOD}', 1), '')) AS period, nullif(regexp_extract(text, '{router.YEAR}', 1), '')::INTEGER AS year, upper(nullif(regexp_extract(text, '{router.DOC_TYPE}', 1), '')) AS doc_type,
  CASE WHEN (CASE {_INTENT} ELSE 'general' END) = 'qualitative_risk' THEN 0.6 ELSE 0.4 END::DOUBLE AS alpha FROM {source}"""


@query("route_questions", _route_sql(fx.values_sql(fx.QUESTIONS, "query_id", "text")))
def route_questions(spark, sf_dir):
    rows = fx.frame(spark, fx.QUESTIONS, "query_id int, text string")
    return rows.select("query_id", *[c.alias(name) for name, c in router.route(F.col("text")).items()])


@query("route_user_turns", _route_sql("(SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user')"))
def route_user_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return rows.select("query_id", *[c.alias(name) for name, c in router.route(F.col("text")).items()])


# -- graph ----------------------------------------------------------------------------------------------------------

_EDGES = """SELECT concat('R', r_regionkey) AS source, concat('N', n_nationkey) AS target, 'HAS_NATION' AS relation FROM {nation} JOIN {region} ON r_regionkey = n_regionkey
UNION ALL SELECT concat('N', c_nationkey), concat('C', c_custkey), 'HAS_CUSTOMER' FROM {customer}
UNION ALL SELECT concat('C', o_custkey), concat('O', o_orderkey), 'PLACED' FROM {orders}"""
_E = _EDGES.format(nation="nation", region="region", customer="customer", orders="orders")


def edges(spark, sf_dir):
    return spark.sql(_EDGES, **{t: table(spark, sf_dir, t) for t in ("nation", "region", "customer", "orders")})


def regions(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"))


@query("kg_neighbors", f"WITH e AS ({_E}), n AS (SELECT DISTINCT target AS id FROM e WHERE relation = 'HAS_NATION') SELECT source AS start, target AS id FROM e WHERE source IN (SELECT id FROM n) UNION ALL SELECT target, source FROM e WHERE target IN (SELECT id FROM n)")
def kg_neighbors(spark, sf_dir):
    every = edges(spark, sf_dir)
    return graph.neighbours(every, every.where("relation = 'HAS_NATION'").select(F.col("target").alias("id")), direction="both")


@query("kg_multi_hop", f"WITH e AS ({_E}) SELECT DISTINCT a.source AS start, c.target AS id FROM e a JOIN e b ON b.source = a.target JOIN e c ON c.source = b.target WHERE a.relation = 'HAS_NATION' AND b.relation = 'HAS_CUSTOMER' AND c.relation = 'PLACED'")
def kg_multi_hop(spark, sf_dir):
    return graph.multi_hop(edges(spark, sf_dir), regions(spark, sf_dir), ["has_nation", "HAS_CUSTOMER", "placed"])


@query("kg_complete_nodes", f"WITH e AS ({_E}), ids AS (SELECT source AS id FROM e UNION SELECT target FROM e) SELECT id, CASE WHEN starts_with(id, 'R') THEN 'REGION' ELSE 'ENTITY' END AS node_type, CASE WHEN starts_with(id, 'R') THEN r_name ELSE id END AS label FROM ids LEFT JOIN region ON id = 'R' || r_regionkey")
def kg_complete_nodes(spark, sf_dir):
    """Regions are stated twice with different properties; ends of edges become entities."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit("region").alias("node_type"), F.col("r_name").alias("label"))
    nodes = r.withColumns({"properties": F.create_map(F.lit("a"), F.lit("1")), "seq": F.lit(1)}).unionByName(r.withColumns({"label": F.lit("later"), "properties": F.create_map(F.lit("a"), F.lit("2")), "seq": F.lit(2)}))
    return graph.complete_nodes(graph.merge_nodes(nodes), edges(spark, sf_dir)).select("id", "node_type", "label")


@query("kg_build", "SELECT 'TICKER_ACME' AS source, 'PERIOD_ACME_2024_FY' AS target, 'REPORTED_IN' AS relation UNION ALL SELECT 'PERIOD_ACME_2024_FY', 'METRIC_ACME_2024_FY_Revenue', 'HAS_METRIC' UNION ALL SELECT 'PERIOD_ACME_2024_FY', 'RISK_c1', 'EXPOSED_TO_RISK' UNION ALL SELECT 'TICKER_UNKNOWN', 'PERIOD_UNKNOWN_2025_FY', 'REPORTED_IN'")
def kg_build(spark, sf_dir):
    meta = fx.frame(spark, [(1, "ACME", 2024, "FY"), (2, None, None, None)], "doc_id int, ticker string, year int, period string")
    metrics = fx.frame(spark, [(1, "Revenue", 1.25e9, "USD", "millions")], "doc_id int, name string, normalized double, unit string, scale string")
    chunks = fx.frame(spark, [(1, "c1", "ITEM 1A. RISK FACTORS", "Copper is scarce."), (1, "c2", "ITEM 1. BUSINESS", "Sensors.")], "doc_id int, chunk_id string, section_title string, content string")
    return graph.from_documents(meta, metrics, chunks)[1].select("source", "target", "relation")


#: Documents as filings: language as ticker, source as period, their length as a metric; every third one names a risk.
_FILED = "SELECT doc_id, upper(lang) AS ticker, CAST(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 2020 + doc_id % 5 END AS INT) AS year, upper(source) AS period, n_chars, coalesce(text, '') AS content, CASE WHEN doc_id % 3 = 0 THEN 'Item 1A: Risk Factors' WHEN doc_id % 3 = 1 THEN 'Item 1: Business' END AS section_title FROM documents"
_KG = f"""f AS ({_FILED}), k AS (SELECT *, coalesce(ticker, 'UNKNOWN') AS t, coalesce(year::VARCHAR, '2025') || '_' || coalesce(period, 'FY') AS p FROM f),
i AS (SELECT *, 'TICKER_' || t AS tid, 'PERIOD_' || t || '_' || p AS pid, 'METRIC_' || t || '_' || p || '_Length' AS mid, 'RISK_' || doc_id AS rid, contains(lower(section_title), 'risk') AS risky FROM k)"""


def _filed(spark, sf_dir):
    rows = spark.sql(_FILED.replace("FROM documents", "FROM {docs}"), docs=table(spark, sf_dir, "documents"))
    metrics = rows.select("doc_id", F.lit("Length").alias("name"), F.col("n_chars").alias("normalized"), F.lit("chars").alias("unit"), F.lit("ones").alias("scale"))
    return graph.from_documents(rows.select("doc_id", "ticker", "year", "period"), metrics, rows.select("doc_id", F.col("doc_id").alias("chunk_id"), "section_title", "content"))


@query("kg_document_edges", f"WITH {_KG} SELECT tid AS source, pid AS target, 'REPORTED_IN' AS relation FROM i UNION ALL SELECT pid, mid, 'HAS_METRIC' FROM i UNION ALL SELECT pid, rid, 'EXPOSED_TO_RISK' FROM i WHERE risky")
def kg_document_edges(spark, sf_dir):
    """The edges of every document's filing."""
    return _filed(spark, sf_dir)[1].select("source", "target", "relation")


@query(
    "kg_document_nodes",
    f"""WITH {_KG} SELECT tid AS id, 'TICKER' AS node_type, t AS label, 'ticker=' || t AS properties FROM i GROUP BY tid, t
UNION ALL SELECT pid, 'PERIOD', t || ' ' || p, 'period=' || arg_max(coalesce(period, ''), doc_id) || ';year=' || arg_max(coalesce(year::VARCHAR, ''), doc_id) FROM i GROUP BY pid, t, p
UNION ALL SELECT mid, 'METRIC', 'Length', 'scale=ones;unit=chars;value=' || coalesce(arg_max(coalesce(n_chars::VARCHAR, ''), doc_id), '') FROM i GROUP BY mid
UNION ALL SELECT rid, 'RISK_FACTOR', trim(left(content, 80), ' ') || '...', 'chunk_id=' || doc_id FROM i WHERE risky""",
)
def kg_document_nodes(spark, sf_dir):
    """The nodes of every document's filing, with their merged properties."""
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return _filed(spark, sf_dir)[0].select("id", "node_type", "label", shown.alias("properties"))


@query("kg_dot", f"WITH e AS ({_E}) SELECT '  \"' || source || '\" -> \"' || target || '\" [label=\"' || relation || '\"];' AS line FROM e")
def kg_dot(spark, sf_dir):
    none = fx.frame(spark, [], "id string, node_type string, label string, properties map<string,string>")
    return graph.to_dot(none, edges(spark, sf_dir))


# -- caches ---------------------------------------------------------------------------------------------------------


def requests(spark, sf_dir):
    """Users ask by event type and hour of day; each user's requests are a cache's trace."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("cache_id"), F.col("event_id").alias("seq"), F.concat_ws("-", "event_type", F.hour("ts").cast("string")).alias("key"), "ts")


_TRACE = "trace AS (SELECT user_id AS cache_id, event_id AS seq, event_type || '-' || hour(ts) AS key FROM events)"


@query(
    "cache_replay_lru",
    f"""WITH {_TRACE}, p AS (SELECT *, lag(seq) OVER (PARTITION BY cache_id, key ORDER BY seq) AS before FROM trace)
SELECT cache_id, seq, key, before IS NOT NULL AND (SELECT count(DISTINCT t.key) FROM trace t WHERE t.cache_id = p.cache_id AND t.seq > p.before AND t.seq < p.seq AND t.key <> p.key) < 16 AS hit FROM p""",
)
def cache_replay_lru(spark, sf_dir):
    """A key is still there if fewer than 16 others came since."""
    return caches.replay(requests(spark, sf_dir), 16, "lru").select("cache_id", "seq", "key", "hit")


def _replay_sql(capacity: int, policy: str, ttl_s: float | None = None, out: str = "cache_id, seq, key, hit, evicted") -> str:
    """The same replay, request by request: the state of each cache is a list of entries."""
    rank = {"lru": "[x.used]", "lfu": "[x.uses, x.used]", "fifo": "[x.made]"}[policy]
    fresh = f"now - x.born <= {ttl_s}" if ttl_s is not None else "true"
    return f"""WITH RECURSIVE numbered AS (SELECT user_id AS cache_id, event_id AS seq, event_type || '-' || hour(ts) AS key, epoch_us(ts) / 1e6 AS now, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
sim AS (
  SELECT cache_id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS key, false AS hit, NULL::VARCHAR AS evicted, []::STRUCT(key VARCHAR, used BIGINT, uses BIGINT, made BIGINT, born DOUBLE)[] AS e FROM (SELECT DISTINCT cache_id FROM numbered)
  UNION ALL
  SELECT cache_id, n, seq, key, hit, victim.key,
    CASE WHEN hit THEN list_transform(own, lambda x: CASE WHEN x.key = mine THEN {{'key': x.key, 'used': n, 'uses': x.uses + 1, 'made': x.made, 'born': x.born}} ELSE x END)
    ELSE list_append(list_filter(own, lambda x: victim IS NULL OR x.key <> victim.key), {{'key': key, 'used': n, 'uses': 1::BIGINT, 'made': n, 'born': now}}) END
  FROM (SELECT *, CASE WHEN NOT hit AND len(own) >= {capacity} THEN list_reduce(own, lambda a, x: CASE WHEN {rank} < {rank.replace("x.", "a.")} THEN x ELSE a END) END AS victim
    FROM (SELECT *, CASE WHEN NOT hit AND len(without) >= {capacity} THEN list_filter(without, lambda x: {fresh}) ELSE without END AS own
      FROM (SELECT *, CASE WHEN hit THEN e ELSE list_filter(e, lambda x: x.key <> mine) END AS without
        FROM (SELECT s.cache_id, r.n, r.seq, r.key, r.key AS mine, r.now, s.e, len(list_filter(s.e, lambda x: x.key = r.key AND {fresh.replace("now", "r.now")})) > 0 AS hit FROM sim s JOIN numbered r ON r.cache_id = s.cache_id AND r.n = s.n + 1))))
)
SELECT {out} FROM sim WHERE n > 0"""


_REPLAYED = ("cache_id", "seq", "key", "hit", "evicted")


@query("cache_replay_lfu", _replay_sql(16, "lfu"))
def cache_replay_lfu(spark, sf_dir):
    return caches.replay(requests(spark, sf_dir), 16, "lfu").select(*_REPLAYED)


@query("cache_replay_fifo", _replay_sql(16, "fifo"))
def cache_replay_fifo(spark, sf_dir):
    return caches.replay(requests(spark, sf_dir), 16, "fifo").select(*_REPLAYED)


@query("cache_replay_lru_ttl", _replay_sql(12, "lru", 86400.0))
def cache_replay_lru_ttl(spark, sf_dir):
    """Capacity and expiry in one: expired entries go before the least recently used does."""
    return caches.replay(requests(spark, sf_dir), 12, "lru", 86400.0).select(*_REPLAYED)


@query("cache_replay_lfu_ttl", _replay_sql(8, "lfu", 43200.0))
def cache_replay_lfu_ttl(spark, sf_dir):
    return caches.replay(requests(spark, sf_dir), 8, "lfu", 43200.0).select(*_REPLAYED)


@query("cache_replay_telemetry", f"SELECT count(*) AS requests, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 4) AS hit_rate, count(*) FILTER (hit) AS exact_hits, 0::BIGINT AS semantic_hits, count(evicted) AS evictions FROM ({_replay_sql(12, 'lru', 86400.0)})")
def cache_replay_telemetry(spark, sf_dir):
    return caches.telemetry(caches.replay(requests(spark, sf_dir), 12, "lru", 86400.0))


@query(
    "cache_telemetry",
    f"""WITH {_TRACE}, p AS (SELECT *, lag(seq) OVER (PARTITION BY cache_id, key ORDER BY seq) AS before FROM trace),
h AS (SELECT before IS NOT NULL AND (SELECT count(DISTINCT t.key) FROM trace t WHERE t.cache_id = p.cache_id AND t.seq > p.before AND t.seq < p.seq AND t.key <> p.key) < 16 AS hit FROM p)
SELECT count(*) AS requests, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 4) AS hit_rate FROM h""",
)
def cache_telemetry(spark, sf_dir):
    return caches.telemetry(cache_replay_lru(spark, sf_dir))


@query(
    "query_cache_ttl",
    """WITH RECURSIVE k AS (SELECT event_type || '-' || user_id AS key, event_id AS seq, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT key, seq, n, t AS put, false AS hit FROM k WHERE n = 1 UNION ALL SELECT k.key, k.seq, k.n, CASE WHEN k.t - r.put <= 86400 THEN r.put ELSE k.t END, k.t - r.put <= 86400 FROM r JOIN k ON k.key = r.key AND k.n = r.n + 1)
SELECT key, seq, hit FROM r""",
)
def query_cache_ttl(spark, sf_dir):
    """Entries last a day from when they were put."""
    rows = table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), "ts")
    return caches.ttl_hits(rows, 86400)


@query(
    "semantic_cache_lookup",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, 'Question  ' || (vec_id % 130) AS text FROM embeddings),
e AS (SELECT * FROM v WHERE vec_id % 50 <> 0), q AS (SELECT * FROM v WHERE vec_id % 50 = 0), n AS (SELECT regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') AS norm, max(vec_id) AS entry_id FROM e GROUP BY ALL),
x AS (SELECT q.vec_id AS query_id, n.entry_id, q.v FROM q LEFT JOIN n ON n.norm = regexp_replace(lower(trim(q.text)), '\\s+', ' ', 'g')),
s AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT x.query_id, e.vec_id, round(list_inner_product(x.v, e.v) / sqrt(list_inner_product(x.v, x.v)) / sqrt(list_inner_product(e.v, e.v)), 6) AS score FROM x JOIN e ON x.entry_id IS NULL))
SELECT query_id, 'exact' AS hit_type, 1.0::DOUBLE AS similarity, entry_id FROM x WHERE entry_id IS NOT NULL
UNION ALL SELECT query_id, CASE WHEN score >= 0.4 THEN 'semantic' ELSE 'none' END, round(greatest(score, 0.0)::DECIMAL(18, 6), 4)::DOUBLE, CASE WHEN score >= 0.4 THEN vec_id END FROM s WHERE rank = 1""",
)
def semantic_cache_lookup(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.concat(F.lit("Question  "), (F.col("vec_id") % 130).cast("string")).alias("text"))
    return caches.lookup(v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), v.where("vec_id % 50 <> 0").withColumnRenamed("vec_id", "entry_id"), 0.4)


@query("query_cache_keys", "SELECT conv_id, turn, sha256(regexp_replace(lower(trim(coalesce(text, ''))), '\\s+', ' ', 'g') || '|' || role || '||5|0.50') AS key FROM conversations")
def query_cache_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("conv_id", "turn", caches.query_key(F.col("text"), F.col("role"), F.lit(None)).alias("key"))


@query("embedding_cache_misses", "SELECT DISTINCT sha256(coalesce(text, '')) AS key FROM documents WHERE coalesce(text, '') NOT IN (SELECT coalesce(text, '') FROM documents WHERE doc_id % 2 = 0)")
def embedding_cache_misses(spark, sf_dir):
    """Even documents are cached; what the others need once each."""
    docs = table(spark, sf_dir, "documents")
    return caches.embedding_misses(docs.select("text"), docs.where("doc_id % 2 = 0").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")).distinct()).select("key")


@query("dedupe_last_wins", "SELECT text, max(doc_id) AS doc_id FROM documents GROUP BY text")
def dedupe_last_wins(spark, sf_dir):
    return caches.last_wins(table(spark, sf_dir, "documents").select("text", "doc_id"), "text", "doc_id")


# -- manifests and JSON ---------------------------------------------------------------------------------------------


@query("corpus_manifest", "SELECT count(*) AS documents, count(DISTINCT source) AS sources, array_to_string(list_sort(list(DISTINCT upper(lang))), ',') AS tickers, sum(length(coalesce(text, '')))::BIGINT AS characters FROM documents")
def corpus_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("source").alias("sources"), F.array_join(F.array_sort(F.collect_set(F.upper("lang"))), ",").alias("tickers"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"))


@query("json_roundtrip", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_roundtrip(spark, sf_dir):
    """Properties to a struct, to JSON and back; unknown fields are dropped."""
    rows = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    again = rows.withColumn("again", F.from_json(F.to_json(F.struct(F.col("p.k").alias("k"), F.lit(1).alias("unknown"))), "k bigint"))
    return again.select("event_id", F.col("again.k").alias("k"))


@query("filename_metadata", "SELECT 'AAPL_10Q_2025_Q3.txt' AS filename, 'AAPL' AS ticker, '10Q' AS doc_type, 2025 AS year, 'Q3' AS period UNION ALL SELECT 'msft-10K-2024.pdf', 'MSFT', '10K', 2024, NULL UNION ALL SELECT 'notes.md', NULL, 'FILING', NULL, NULL")
def filename_metadata(spark, sf_dir):
    from findoc.sources.files import filename_metadata as found

    rows = fx.frame(spark, ["AAPL_10Q_2025_Q3.txt", "msft-10K-2024.pdf", "notes.md"], "filename string")
    return rows.select("filename", *[c.alias(name) for name, c in found(F.col("filename")).items()])


@query("modality_counts", "SELECT CASE WHEN length(text) - length(replace(text, '|', '')) >= 4 OR (contains(text, '|') AND contains(text, '---')) THEN 'table' ELSE 'text' END AS modal_type, count(*) AS n FROM (SELECT coalesce(text, '') AS text FROM documents) GROUP BY ALL")
def modality_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("text"))
    return docs.groupBy(parse.modality(F.col("text")).alias("modal_type")).agg(F.count(F.lit(1)).alias("n"))
