"""What the whole-table queries do not show: empty inputs, nulls, ties, errors, state."""

import json
import random
import shutil
import time
import zipfile
from collections import Counter, OrderedDict

import duckdb
import pytest
from pyspark.sql import functions as F

from findoc import cli, interfaces, tools
from findoc.functions import cleaning, finance, models
from findoc.operators import caches, dense, fusion, graph, grounding, lexical, parse, rerank, router, tables
from findoc.plans.answers import NOTHING, Settings, answer, ask
from findoc.sources import facts, files, persist, synthetic
from findoc.streaming import incremental


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


def test_tokens(spark):
    from findoc.functions.tokens import lexical_tokens

    assert one(spark, lexical_tokens(F.col("text")), "Up $1,250 and (450) a 7 14.5%") == ["up", "$1,250", "and", "-450", "7", "14.5%", "$1250", "1,250", "1250", "14.5"]
    assert one(spark, lexical_tokens(F.col("text")), None) == []


def test_lexical_index_of_nothing(spark):
    empty = spark.createDataFrame([], "chunk_id int, text string")
    index = lexical.fit(empty)
    assert index.statistics().first()["corpus_size"] == 0
    assert index.search(spark.createDataFrame([(1, "x y")], "query_id int, text string")).count() == 0


def test_lexical_ties_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(2, "alpha beta"), (1, "alpha beta"), (3, None), (4, "")], "chunk_id int, text string")
    hits = lexical.fit(rows).search(spark.createDataFrame([(1, "alpha alpha"), (2, "none")], "query_id int, text string")).collect()
    assert [(r["chunk_id"], r["rank"]) for r in hits] == [(1, 1), (2, 2)]
    once = lexical.fit(rows).search(spark.createDataFrame([(1, "alpha")], "query_id int, text string")).first()["score"]
    assert hits[0]["score"] == pytest.approx(2 * once)


def test_dense_search_in_blocks_and_zero_vectors(spark, monkeypatch):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, [2.0, 0.0])], "chunk_id int, vector array<double>")
    asked = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "query_id int, vector array<double>")
    whole = sorted(map(tuple, dense.search(index, asked, 3).select("query_id", "rank", "chunk_id").collect()))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, dense.search(index, asked, 3).select("query_id", "rank", "chunk_id").collect())) == whole
    assert [r[2] for r in whole if r[0] == 0] == [1, 4, 2]


def test_own_embedding_function(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "chunk_id int, text string")
    got = dense.embed(rows, make=lambda: lambda texts: [[float(len(t or "")), 1.0] for t in texts]).collect()
    assert {r["chunk_id"]: r["vector"] for r in got} == {1: [3.0, 1.0], 2: [0.0, 1.0]}


def test_min_max_of_equal_scores(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 0.0)], "query_id int, score double")
    assert sorted(r[0] for r in rows.select(fusion.min_max(F.col("score"))).collect()) == [0.0, 1.0, 1.0]


def test_evaluate_nothing(spark):
    none = spark.createDataFrame([], "query_id int, chunk_id int, rank int")
    got = fusion.evaluate(none, none.drop("rank"), none.select("query_id")).first()
    assert (got["recall_at_1"], got["mrr"], got["ndcg"], got["query_count"]) == (0.0, 0.0, 0.0, 0)


def test_rerank_threshold_and_strategy(spark):
    q = spark.createDataFrame([(1, "revenue in 2024")], "query_id int, text string")
    c = spark.createDataFrame([(1, "Revenue for 2024 was 10", "table"), (2, "", "text")], "chunk_id int, text string, modal_type string")
    pool = spark.createDataFrame([(1, 1, 0.4, 2), (1, 2, 0.5, 1)], "query_id int, chunk_id int, score double, rank int")
    assert [r["chunk_id"] for r in rerank.rerank(pool, q, c).collect()] == [1, 2]
    assert [r["chunk_id"] for r in rerank.rerank(pool, q, c, threshold=0.6).collect()] == [1]
    assert "Year match: 2024" in rerank.rerank(pool, q, c).first()["explanation"]
    with pytest.raises(ValueError):
        rerank.rerank(pool, q, c, "other")


def test_rerank_rounds_scores_as_sql(spark):
    q = spark.createDataFrame([(1, "alpha beta")], "query_id int, text string")
    c = spark.createDataFrame([(k, "alpha", "text") for k in range(400)], "chunk_id int, text string, modal_type string")
    pool = spark.createDataFrame([(1, k, (3005 + 10 * k) / 1e5, k + 1) for k in range(400)], "query_id int, chunk_id int, score double, rank int")
    got = rerank.rerank(pool, q, c, "heuristic", 400).select("chunk_id", "heuristic_score", "explanation").orderBy("chunk_id").collect()
    want = duckdb.sql("SELECT k::INTEGER AS chunk_id, round(h, 4) AS h, 'Heuristic score: ' || printf('%.4f', round(h, 4)) || '; Lexical overlap: 0.50' FROM (SELECT k, (3005 + 10 * k) / 1e5::DOUBLE + 0.3 * 0.5::DOUBLE AS h FROM range(400) AS r(k)) ORDER BY k").fetchall()
    assert [tuple(r) for r in got] == want


def test_cleaning_nulls(spark):
    assert one(spark, cleaning.clean_document(F.col("text")), None) == ""
    assert one(spark, cleaning.clean_document(F.col("text")), "a\n\n\n\n\n\nb  ") == "a\n\n\nb"


def test_sql_functions(spark):
    finance.register(spark)
    got = spark.sql("SELECT scale_multiplier(' Millions '), amount_value('(1,250)'), pct_change(100, 150), pct_change(0, 1)").first()
    assert tuple(got) == (1e6, -1250.0, 50.0, None)


def test_variance_edges(spark):
    rows = spark.createDataFrame([(0.0, 5.0), (-10.0, -5.0), (1.0, 1.00001)], "b double, c double")
    got = [(r["percentage_change"], r["trend"]) for r in rows.select(finance.variance(F.col("b"), F.col("c")).alias("v")).select("v.*").collect()]
    assert got == [(None, "UP"), (50.0, "UP"), (0.0, "FLAT")]


def test_chunks_of_odd_documents(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 901)], "doc_id int, text string")
    got = parse.chunk_documents(rows).orderBy("doc_id", "seq").collect()
    assert [(r["doc_id"], r["start_idx"], r["token_count"]) for r in got] == [(3, 0, 650), (3, 400, 650), (3, 800, 131)]


def test_amounts_are_looked_for_once_a_paragraph(spark):
    text = "Net income of 45 million. " + "some words that go on " * 20_000 + ". Cash was $7"
    began = time.perf_counter()
    got = parse.chunk_documents(spark.createDataFrame([(1, text)], "doc_id int, text string")).select("seq", F.explode("metrics").alias("m")).select("seq", "m.*").orderBy("seq").collect()
    assert time.perf_counter() - began < 20
    assert [tuple(r) for r in got] == [(0, "Net income", "45 million"), (249, "Cash", "$7"), (250, "Cash", "$7")]


def test_shortened_text_has_the_same_amounts(spark):
    draw = random.Random(5)
    parts = ["revenue", "Net income", "cash flow ", " was ", "of", "a", "é", "ß", "x_", "_", "$", "$5", "1,250", "41.6", "7", "%", " million", "million", "B", "k ", " ", "  ", "\n", "\t", ".", ", ", "-", "(", "1,2", "$$", "debt debt debt debt debt debt debt", "\u2028"]
    rows = spark.createDataFrame([("".join(draw.choices(parts, k=draw.randint(0, 14))),) for _ in range(20_000)], "text string")
    both = lambda t: F.arrays_zip(F.regexp_extract_all(t, F.lit(parse.INLINE), F.lit(1)).alias("name"), F.regexp_extract_all(t, F.lit(parse.INLINE), F.lit(2)).alias("raw"))
    whole, short = both(F.col("text")), both(F.regexp_replace("text", parse.NO_INLINE, "$1$2"))
    assert rows.where(F.size(whole) > 0).count() > 3_000
    assert [r["text"] for r in rows.where(F.to_json(whole) != F.to_json(short)).limit(3).collect()] == []


def test_offsets_cut_the_text_back(spark):
    texts = {1: "Cover\n\nItem 1. Business\nWe make \x01 sensors.\nITEM 7A. Quantitative and Qualitative Disclosures\nNone.", 2: "one\n\nthree é😀\n", 3: "", 4: "Item 2. Properties", 5: None}
    df = spark.createDataFrame(list(texts.items()) + [(2, texts[2])], "doc_id int, text string")
    lines = sorted((r["doc_id"], r["pos"], r["line"], r["start_at"], r["end_at"]) for r in parse.line_spans(df).collect())
    assert all((texts[k] or "")[a:b] == line for k, _, line, a, b in lines)
    assert Counter(x[0] for x in lines) == {1: 6, 2: 8, 3: 1, 4: 1, 5: 1}
    spans = sorted((r["doc_id"], r["label"], r["start_at"], r["end_at"]) for r in parse.section_spans(df).collect())
    at, end = texts[1].index("\nItem 1."), len(texts[1])
    cut = [(texts[k] or "")[a:b].strip() for k, _, a, b in spans if k == 1]
    assert cut == ["Cover", texts[1][at + 1 : texts[1].index("\nITEM")], texts[1][texts[1].index("ITEM") :]] and spans[0][2] == 0 and spans[2][3] == end
    assert spans[3:] == [(2, "General Filing", 0, len(texts[2]))] * 2 + [(3, "General Filing", 0, 0), (4, "Item 2: Properties", 0, 18), (5, "General Filing", 0, 0)]


def test_table_access(spark):
    text = "| Item | Now |\n| --- | --- |\n| a | 1 |\n| b |"
    row = spark.createDataFrame([(text,)], "text string").select(tables.parse_markdown(F.col("text")).alias("t"))
    assert row.select(tables.column_values(F.col("t"), "now").alias("x")).first()["x"] == ["1", ""]
    assert row.select(tables.column_values(F.col("t"), "gone").alias("x")).first()["x"] == []
    assert row.select(tables.to_records(F.col("t")).alias("x")).first()["x"][1] == {"Item": "b", "Now": ""}


def test_multi_hop_without_path(spark):
    e = spark.createDataFrame([("a", "b", "X"), ("b", "c", "Y"), ("b", "c", "Y")], "source string, target string, relation string")
    start = spark.createDataFrame([("a",)], "id string")
    assert [tuple(r) for r in graph.multi_hop(e, start, ["x", "y"]).collect()] == [("a", "c")]
    assert graph.multi_hop(e, start, ["y"]).count() == 0
    assert graph.neighbours(e, spark.createDataFrame([("b",)], "id string"), "Y").count() == 2


def test_router_ignores_common_words(spark):
    rows = spark.createDataFrame([(1, "WHAT IS THE revenue of ACME")], "query_id int, text string")
    got = router.build_queries(rows).first()
    assert (got["ticker"], got["intent"], got["reranker_strategy"]) == ("ACME", "metric_lookup", "heuristic")


def test_claims_without_evidence(spark):
    c = spark.createDataFrame([(1, 0, "Revenue was 5 million."), (2, 0, "Nothing here at all.")], "query_id int, claim_id int, claim string")
    e = spark.createDataFrame([(1, 1, "Revenue was 5,000 million")], "query_id int, chunk_id int, text string")
    got = {r["query_id"]: r for r in grounding.verify_claims(c, e).collect()}
    assert got[1]["unsupported_numbers"] == [] and got[1]["n_citations"] == 1
    assert got[2]["status"] == "UNSUPPORTED" and got[2]["support_score"] == 0.0


def _model(trace, capacity, policy):
    entries, clock, out = OrderedDict(), 0, []
    for key in trace:
        clock += 1
        hit = key in entries
        if hit:
            entries[key][0], entries[key][1] = clock, entries[key][1] + 1
        else:
            if len(entries) == capacity:
                rank = {"lru": lambda e: e[0], "lfu": lambda e: (e[1], e[0]), "fifo": lambda e: e[2]}[policy]
                del entries[min(entries, key=lambda k: rank(entries[k]))]
            entries[key] = [clock, 1, clock]
        out.append(hit)
    return out


@pytest.mark.parametrize("policy", ["lru", "lfu", "fifo"])
def test_replay_follows_a_model(spark, policy):
    import random

    rng = random.Random(4)
    trace = [rng.choice("abcdefg") for _ in range(300)]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(trace)], "cache_id int, seq int, key string")
    got = [r["hit"] for r in caches.replay(rows, 3, policy).orderBy("seq").collect()]
    assert got == _model(trace, 3, policy)
    with pytest.raises(ValueError):
        caches.replay(rows, 3, "other")


def test_answer_of_nothing(spark):
    q = spark.createDataFrame([(1, "anything at all?")], "query_id int, text string")
    empty = spark.createDataFrame([], "chunk_id int, text string, modal_type string")
    assert answer(q, empty, Settings(reranker=None))["answers"].first()["text"] == NOTHING


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "AAPL_10K_2024_FY24.txt").write_bytes(b"<p>caf\xff</p> ($5)")
    (tmp_path / "sub" / "b.json").write_text('{"content": "hello", "other": 1}')
    (tmp_path / "c.json").write_text('{"x": 1}')
    (tmp_path / "broken.pdf").write_bytes(b"no pdf")
    got = files.read_texts(spark, str(tmp_path)).first()
    assert got["ticker"] == "AAPL" and got["period"] == "FY24" and got["text"].endswith("-$5")
    assert sorted(r["text"] for r in files.read_json(spark, str(tmp_path)).collect()) == ["hello", '{"x": 1}']
    assert files.read_pages(spark, str(tmp_path)).first()["error"]
    pages = spark.createDataFrame([("f", 2, "two", None), ("f", 1, "one", None)], "path string, page_number int, text string, error string")
    assert files.join_pages(pages).first()["text"] == "one\n\n--- PAGE BREAK ---\n\ntwo"


def test_index_that_changed_is_refused(spark, tmp_path):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "chunk_id int, text string")
    index = lexical.fit(rows)
    persist.save_index(index, rows, None, str(tmp_path / "i"))
    loaded, chunks, vectors, manifest = persist.load_index(spark, str(tmp_path / "i"))
    assert chunks.count() == 2 and vectors is None and manifest["k1"] == 1.5
    asked = spark.createDataFrame([(1, "alpha")], "query_id int, text string")
    assert loaded.search(asked).first()["score"] == pytest.approx(index.search(asked).first()["score"])
    spark.createDataFrame([(9, "x")], "chunk_id int, text string").write.mode("append").parquet(str(tmp_path / "i" / "chunks"))
    with pytest.raises(ValueError):
        persist.load_index(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError):
        persist.load_index(spark, str(tmp_path / "none"))


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "alpha")], "doc_id bigint, text string")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = incremental.document_stream(spark, str(tmp_path / "in"), files=1)
        incremental.index_stream(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "chunks")).count() == 2
    counts = incremental.term_counts(incremental.document_stream(spark, str(tmp_path / "in")))
    counts.writeStream.format("memory").queryName("terms").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("terms").collect()} == {("alpha", 2), ("beta", 1)}


def test_stream_counts_come_from_its_postings(spark, tmp_path):
    texts = [" ".join(f"w{k * k % 37}" for k in range(n)) for n in (950, 400, 501, 800)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = incremental.document_stream(spark, str(tmp_path / "in"), files=1)
    incremental.index_stream(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = {r["term"]: r["tf"] for r in incremental.posting_counts(spark, str(tmp_path / "out")).collect()}
    assert got == Counter(" ".join(texts).split())
    shutil.rmtree(tmp_path / "out" / "postings" / "batch=1")  # what the stream lost is missing
    assert sum(r["tf"] for r in incremental.posting_counts(spark, str(tmp_path / "out")).collect()) < sum(got.values())


def test_cached_answers_stream(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    rows = [("a", start), ("a", start + dt.timedelta(seconds=5)), ("a", start + dt.timedelta(seconds=30)), ("b", start)]
    spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    incremental.cached_answers(stream, 10).writeStream.format("memory").queryName("cached").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["key"], r["ts"].second, r["hit"]) for r in spark.table("cached").collect()) == [("a", 0, False), ("a", 5, True), ("a", 30, False), ("b", 0, False)]


@pytest.mark.parametrize("policy", ["lru", "lfu", "fifo"])
def test_expiry_capacity_and_nearest_entry_in_one(spark, policy):
    """Entries expire before a victim is looked for; the nearest of what is fresh answers."""
    cache = caches.Cache(2, policy, 10.0, 0.9)
    assert cache.put("a", 0, [1.0, 0.0]) is None and cache.put("b", 5, [0.0, 1.0]) is None
    assert cache.get("a", 9)[0] == "exact" and cache.get("x", 9, [0.1, 1.0])[::2] == ("semantic", "b")
    assert cache.get("x", 9, [1.0, 1.0])[0] == "none"
    assert cache.put("c", 12, [1.0, 1.0]) is None and set(cache.entries) == {"b", "c"}  # a had expired
    assert cache.get("y", 12, [1.0, 0.05])[0] == "none"
    gone = cache.put("d", 13)
    assert gone == {"lru": "b", "lfu": "c", "fifo": "b"}[policy]
    assert cache.put("d", 14) is None and cache.entries["d"][1] == 2  # in place
    rows = spark.createDataFrame([(1, k, x, t, v) for k, (x, t, v) in enumerate([("a", 0, [1.0, 0.0]), ("a", 5, [1.0, 0.0]), ("b", 6, [1.0, 0.01]), ("a", 20, [1.0, 0.0])])], "cache_id int, seq int, key string, t int, vector array<double>")
    got = caches.replay(rows.withColumn("ts", F.timestamp_seconds("t")), 5, policy, 10.0, 0.9).orderBy("seq").collect()
    assert [(r["hit_type"], r["entry"]) for r in got] == [("none", None), ("exact", "a"), ("semantic", "a"), ("none", None)]


def test_questions_behind_both_caches(spark):
    chunks = spark.createDataFrame([(1, "Total revenue was $1,250 million in 2024.", "text"), (2, "Copper is scarce.", "text")], "chunk_id int, text string, modal_type string")
    asked = [(1, 1, "What was total revenue?", 0), (2, 2, "what  was TOTAL revenue?", 10), (3, 3, "Is copper scarce?", 20), (4, 4, "What was total revenue?", 5000)]
    rows = spark.createDataFrame(asked, "query_id int, seq int, text string, t int").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["query_id"]: r for r in ask(rows, chunks, Settings(top_k=1))["responses"].collect()}
    assert [(got[k]["cache_type"], got[k]["answered_by"]) for k in (1, 2, 3, 4)] == [("none", 1), ("exact", 1), ("none", 3), ("none", 4)]
    assert "1,250" in got[2]["text"] and got[2]["text"] == got[1]["text"]


def test_questions_with_filters_of_their_own(spark):
    hits = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (1, 12, 0.7, 3), (2, 10, 0.9, 1)], "query_id int, chunk_id int, score double, rank int")
    own = spark.createDataFrame([(1, "aapl", None, 2024, None), (2, None, None, None, "10-k")], "query_id int, ticker string, period string, year int, doc_type string")
    meta = spark.createDataFrame([(10, "MSFT", "Q1", 2024, "10-Q"), (11, "AAPL", "Q1", None, "10-K")], "chunk_id int, ticker string, period string, year int, doc_type string")
    assert sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in fusion.matching(hits, own, meta).collect()) == [(1, 11, 1), (1, 12, 2)]
    assert fusion.resolve_strategy(use_rrf=False, asked="dense") == "hybrid_convex" and fusion.resolve_strategy("sparse", True) == "sparse" and fusion.resolve_strategy() == "hybrid_rrf"
    with pytest.raises(ValueError):
        fusion.resolve_strategy("other")


def test_own_pair_scorer(spark):
    class Longest:
        def predict(self, pairs):
            return [float(len(d)) for _, d in pairs]

    q = spark.createDataFrame([(1, "x")], "query_id int, text string")
    c = spark.createDataFrame([(1, "aa", "text"), (2, "aaaa", "text"), (3, None, "text")], "chunk_id int, text string, modal_type string")
    pool = spark.createDataFrame([(1, k, 0.5, k) for k in (1, 2, 3)], "query_id int, chunk_id int, score double, rank int")
    got = rerank.rerank(pool, q, c, "cross_encoder", scorer=Longest()).collect()
    assert [r["chunk_id"] for r in got] == [2, 1, 3] and got[0]["cross_encoder_score"] == 1.0
    assert isinstance(Longest(), interfaces.PairScorer) and isinstance(dense.HashingEmbedder(), interfaces.Embedder) and isinstance(caches.Cache(1, "lru", None, None), interfaces.ResponseCache)
    assert isinstance(lexical.fit(c), interfaces.SearchIndex)


def test_dense_search_leaves_out_null_and_other_vectors(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [1.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0])], "chunk_id int, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [2.0])], "query_id int, vector array<double>")
    got = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in dense.search(index, asked, 5).collect())
    assert got == [(1, 1, 1), (1, 2, 3), (3, 1, 4)]
    assert dense.search(index.limit(0), asked).count() == 0 and dense.search(index, asked.limit(0)).count() == 0


def test_vectors_by_id(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id int, vector array<double>")
    more = spark.createDataFrame([(2, [1.0, 1.0]), (3, [0.0, 2.0])], "chunk_id int, vector array<double>")
    assert sorted(r["chunk_id"] for r in dense.append(index, more).collect()) == [1, 2, 2, 3]
    assert {r["chunk_id"]: r["vector"] for r in dense.upsert(index, more).collect()} == {1: [1.0, 0.0], 2: [1.0, 1.0], 3: [0.0, 2.0]}
    pairs = spark.createDataFrame([(1, 2), (1, 9)], "a int, b int")
    assert [tuple(r) for r in dense.similarities(dense.upsert(index, more), pairs).collect()] == [(1, 2, 0.707107)]


def test_embeddings_are_computed_once(spark):
    texts = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "alpha"), (4, None)], "id int, text string")
    cached = dense.embed(texts.where("id = 1").select(F.sha2("text", 256).alias("key"), "text"), "key")
    seen = []
    found, full = caches.get_or_compute(texts, cached, lambda missing: (seen.append(missing.count()), dense.embed(missing, "key"))[1])
    assert seen == [2] and full.count() == 3
    got = {r["id"]: r["vector"] for r in found.collect()}
    assert got[1] == got[3] != got[2] and sum(map(abs, got[4])) == 0


def test_short_numbers_follow_the_general_format(spark):
    values = [0.0, 1.0, -2.5, 450.0, 1250.5, 123456.0, 123456.7, 999999.5, 1e6, 1234567.0, 0.0001, 0.00001234, 1e21, -0.1, 1 / 3]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(models.short_number(F.col("v")).alias("s")).collect()
    assert [r["s"] for r in rows] == [f"{v:g}" for v in values]


def test_enriched_text_of_a_figure(spark):
    row = spark.range(1).select(models.enriched_text(F.lit("body"), F.lit(""), F.lit("figure"), caption=F.lit("Mix"), chart=F.lit("pie"), points=F.array(F.struct(F.lit("a").alias("k"), F.lit(94.2).alias("v"))), metrics=F.array().cast("array<struct<name:string,shown:string>>")).alias("t")).first()
    assert row["t"] == "Figure: Mix\nChart Type: pie\nData: a=94.2\nbody"


def test_tools_over_filings(spark):
    filings = synthetic.filings(spark, 3).withColumn("doc_type", F.lit("10-Q"))
    one = filings.orderBy("doc_id").first()
    chunks = parse.chunk_documents(filings.select("doc_id", "text")).select("doc_id", "chunk_id", F.col("content").alias("text"), "modal_type")
    tool = tools.Tools(spark, filings, chunks)
    got = tool.call("compute_financial_ratios", {"ticker": one["ticker"].lower(), "year": one["year"], "period": one["period"]})
    assert got["gross_margin_pct"] > 0 and not got["synthetic"]
    assert tool.call("compare_filing_periods", {"ticker": "NONE"})["synthetic"] and tool.call("compare_filing_periods", {"ticker": "NONE"})["variances"]
    assert tool.call("query_financial_filings", {"query": "What is total revenue?", "ticker": one["ticker"], "top_k": 1})["citations"]
    assert tool.call("audit_factual_grounding", {"claims": ["Total revenue"]})["total_claims"] > 0
    assert json.loads(tools.respond(tool, '{"id": 1, "method": "tools/list"}'))["result"]["tools"][0]["name"] == "query_financial_filings"
    assert "error" in json.loads(tools.respond(tool, '{"id": 2, "method": "tools/call", "params": {"name": "none"}}')) and tools.respond(tool, '{"method": "x"}') is None
    assert json.loads(tools.respond(tool, "{"))["error"]["code"] == -32700 and json.loads(tools.respond(tool, '{"id": 3, "method": "x"}'))["error"]["code"] == -32601


def test_facts_are_fetched_or_fall_back(spark):
    asked = spark.createDataFrame([("AAPL", 2025, "Q3"), ("ZZZ", 2025, "Q3")], "ticker string, year int, period string")

    def fetch(number):
        if number == "0000320193":
            return '{"entityName": "A", "facts": {}}'
        raise OSError("no network")

    got = {r["ticker"]: r["source"] for r in facts.company_facts(asked, fetch, 0.0).collect()}
    assert got == {"AAPL": "fetched", "ZZZ": "fallback"}


def test_directories_archives_and_parsed_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Revenue was 5 million.")
    (tmp_path / "in" / "blank.txt").write_text(" ")
    (tmp_path / "in" / "b.json").write_text('{"content": "hello"}')
    (tmp_path / "in" / "d.json").write_text('{"doc_id": "d", "chunks": [{"chunk_id": "d_0", "content": "x", "page_number": 0, "other": 1}]}')
    (tmp_path / "in" / "bad.pdf").write_bytes(b"no pdf")
    documents, errors = files.read_directory(spark, str(tmp_path / "in"))
    assert sorted(r["doc_id"] for r in documents.collect()) == ["a", "b"] and errors.count() == 2
    assert [(r["doc_id"], r["chunk_id"], r["page_number"], r["modal_type"]) for r in files.read_json_chunks(spark, str(tmp_path / "in")).collect()] == [("d", "d_0", 1, "text")]
    index, chunks, vectors = persist.rebuild(documents.select("doc_id", "text"))
    persist.save_index(index, chunks, vectors, str(tmp_path / "i"), documents)
    persist.archive(spark, str(tmp_path / "i"), str(tmp_path / "i.zip"))
    persist.unarchive(spark, str(tmp_path / "i.zip"), str(tmp_path / "again"))
    loaded, *_ = persist.load_index(spark, str(tmp_path / "again"))
    assert loaded.term_stats.count() == index.term_stats.count() and persist.load_documents(spark, str(tmp_path / "again")).count() == 2
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x", "y")
    with pytest.raises(ValueError):
        persist.unarchive(spark, str(tmp_path / "bad.zip"), str(tmp_path / "out"))


def test_flagged_numbers_are_rows_and_their_array_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(grounding, "MOST_FLAGGED", 2)
    audited = spark.createDataFrame([(1, 2, 1, 0, 1, ["9", "1"], 0.5, "FAIL"), (2, 1, 1, 0, 0, ["5", "9"], 0.5, "FAIL")], "query_id int, total_claims long, supported_claims long, partially_supported long, unsupported_claims long, unsupported_numbers array<string>, confidence double, status string")
    assert grounding.audit_batch(audited).first()["flagged_numbers"] == ["1", "5"] and grounding.flagged_numbers(audited).count() == 3


@pytest.mark.parametrize("arguments", [["list"], ["benchmark"], ["info", "{in}"], ["audit", "{in}", "What was revenue?"], ["query", "What was revenue?", "{in}", "--ticker", "AAPL", "--explain"], ["compare", "{in}", "{in}"], ["ratios", "{in}"], ["ingest", "{in}"]])
def test_command_line(spark, tmp_path, capfd, arguments):
    (tmp_path / "AAPL_10Q_2025_Q3.txt").write_text("**Table: Income (in millions)**\n| Item | 2025 |\n| --- | --- |\n| Total Revenue | $1,250 |\n| Gross Profit | $520 |\n\nTotal revenue was $1,250 million.")
    cli.main([a.replace("{in}", str(tmp_path)) for a in arguments])
    assert len(capfd.readouterr().out) > 50
