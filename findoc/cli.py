"""Command line: ``python -m findoc.cli COMMAND ...``; every command is a query over Parquet tables or files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: What the audit asks where no question is given.
QUESTIONS = ("What was the revenue?", "What were the gross profit and the operating income?")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="findoc", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *arguments: str) -> argparse.ArgumentParser:
        found = commands.add_parser(name, help=about)
        for a in arguments:
            found.add_argument(a)
        return found

    command("run", "run a registered query over a folder of tables", "query", "folder")
    command("list", "list the registered queries")
    command("info", "the state of an engine over the text files of a folder", "folder")
    command("ingest", "parse the text files of a folder into chunks", "folder").add_argument("--out")
    ask = command("query", "ask a question about the text files of a folder", "text", "folder")
    ask.add_argument("--top-k", type=int, default=5)
    ask.add_argument("--alpha", type=float, default=0.5)
    ask.add_argument("--strategy", default="hybrid_rrf", choices=["sparse", "dense", "hybrid_rrf", "hybrid_convex"])
    ask.add_argument("--reranker", default="hybrid", choices=["cross_encoder", "hybrid", "heuristic", "none"])
    ask.add_argument("--threshold", type=float, default=0.0)
    ask.add_argument("--explain", action="store_true")
    for name in ("ticker", "period", "doc-type"):
        ask.add_argument(f"--{name}")
    ask.add_argument("--year", type=int)
    command("benchmark", "recall and reciprocal rank of lexical, dense and hybrid search").add_argument("--top-k", type=int, default=3)
    command("cache-stats", "what a cache of a capacity and an expiry does with a trace: Parquet of (cache_id, seq, key, ts)", "trace")
    command("ratios", "ratios of the tables in the text files of a folder", "folder")
    command("compare", "variances between the tables of two files or folders", "base", "other")
    audit = command("audit", "ask questions and audit the answers", "folder")
    audit.add_argument("questions", nargs="*")
    audit.add_argument("--max-hallucination-rate", type=float, default=0.05)
    command("serve", "tools as JSON-RPC lines over standard input and output", "folder")
    return parser


def main(argv: list[str] | None = None) -> None:
    options = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("findoc").getOrCreate()

    from findoc import tools
    from findoc.operators import caches, catalog, fusion, grounding, lexical, parse, statements, tables
    from findoc.plans import models, registry
    from findoc.plans.answers import Settings, answer
    from findoc.session import ship
    from findoc.sources.files import read_texts

    ship(spark)

    def read(folder: str):
        docs = read_texts(spark, folder)
        chunks = parse.chunk_documents(docs.select("doc_id", "text")).select("doc_id", "chunk_id", F.col("content").alias("text"), "modal_type")
        return docs, chunks

    if options.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
    elif options.command == "run":
        registry.QUERIES[options.query](spark, options.folder).show(50, truncate=80)
    elif options.command == "benchmark":
        models.strategies(spark, options.top_k).show(truncate=False)
    elif options.command == "cache-stats":
        caches.telemetry(caches.replay(spark.read.parquet(options.trace), 1000, "lru", 3600.0)).show(truncate=False)
    elif options.command == "compare":
        sides = []
        for place in (options.base, options.other):
            found = tables.extract_tables(read(place)[0].select("doc_id", "text")).withColumn("table_id", F.concat_ws("_", "doc_id", "number"))
            sides.append(tables.metrics(found).withColumn("pos", F.struct("table_id", "row_idx", "col_idx")))
        statements.compare_metrics(*sides).orderBy("pos").drop("pos").show(200, truncate=False)
    else:
        docs, chunks = read(options.folder)
        if options.command == "ingest":
            chunks.write.mode("overwrite").parquet(options.out) if options.out else chunks.show(50, truncate=80)
        elif options.command == "info":
            catalog.status(lexical.fit(chunks), chunks).show(truncate=False, vertical=True)
        elif options.command == "query":
            asked = spark.createDataFrame([(1, options.text)], "query_id int, text string")
            settings = Settings(strategy=options.strategy, reranker=None if options.reranker == "none" else options.reranker, top_k=options.top_k, alpha=options.alpha, threshold=options.threshold)
            allow = None
            if options.ticker or options.period or options.year or options.doc_type:
                known = chunks.join(docs.select("doc_id", "ticker", "period", "year", "doc_type"), "doc_id").withColumn("statement_type", F.lit(None).cast("string"))
                allow = fusion.allowed(known, options.ticker, options.period, options.year, options.doc_type).select("chunk_id")
            found = answer(asked, chunks, settings, allow=allow)
            found["answers"].show(truncate=False)
            hits = found["hits"]
            (hits if options.explain or "explanation" not in hits.columns else hits.drop("explanation")).show(truncate=False if options.explain else 120)
        elif options.command == "audit":
            asked = spark.createDataFrame(list(enumerate(options.questions or QUESTIONS)), "query_id int, text string")
            batch = grounding.audit_batch(answer(asked, chunks, Settings())["audited"], options.max_hallucination_rate)
            print(grounding.report_markdown(batch).first()[0])
        elif options.command == "serve":
            server = tools.Tools(spark, docs, chunks)
            for line in sys.stdin:
                if line.strip() and (reply := tools.respond(server, line)):
                    print(reply, flush=True)
        else:
            found = tables.extract_tables(docs.select("doc_id", "text")).withColumn("table_id", F.concat_ws("_", "doc_id", "number"))
            statements.document_ratios(statements.table_ratios(found), found.select("table_id", "doc_id", F.col("number").alias("seq"))).show(truncate=False)


if __name__ == "__main__":
    main()
