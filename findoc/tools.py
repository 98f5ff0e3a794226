"""The engine's answers as tools: a name and arguments in, plain values out. ``schemas`` says what each takes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findoc.functions import models
from findoc.operators import catalog, grounding, statements, tables
from findoc.plans.answers import Settings, answer
from findoc.sources import synthetic


def _string(about: str) -> dict:
    return {"type": "string", "description": about}


def schemas() -> list[dict]:
    """Name, description and JSON schema of the arguments of each tool."""
    integer = {"type": "integer"}
    every = [
        ("query_financial_filings", "Answer a question from the filings, with citations and whether it is grounded.", {"query": _string("the question"), "ticker": _string("only filings of this ticker"), "top_k": integer, "strategy": _string("sparse, dense, hybrid_rrf or hybrid_convex")}, ["query"]),
        ("compute_financial_ratios", "Margins, liquidity and solvency of the filing of a period.", {"ticker": _string("ticker"), "year": integer, "period": _string("period")}, ["ticker"]),
        ("compare_filing_periods", "Variances between the metrics of two periods' filings.", {"ticker": _string("ticker"), "base_period": _string("earlier period"), "compare_period": _string("later period"), "year": integer}, ["ticker"]),
        ("audit_factual_grounding", "Ask each claim as a question and audit the answers.", {"claims": {"type": "array", "items": {"type": "string"}}}, ["claims"]),
    ]
    return [{"name": name, "description": about, "inputSchema": {"type": "object", "properties": given, "required": needed}} for name, about, given, needed in every]


class Tools:
    """Tools over ``filings`` (doc_id, ticker, year, period, doc_type, text) and their ``chunks`` (doc_id, chunk_id, text, modal_type).

    A period without a filing is answered from a synthetic one, and ``synthetic`` says so.
    """

    def __init__(self, spark: SparkSession, filings: DataFrame, chunks: DataFrame):
        self.spark, self.filings, self.chunks = spark, filings, chunks

    def call(self, name: str, arguments: dict) -> dict:
        known = {"query_financial_filings": self.query, "compute_financial_ratios": self.ratios, "compare_filing_periods": self.compare, "audit_factual_grounding": self.audit}
        if name not in known:
            raise ValueError(f"unknown tool {name!r}")
        return known[name](**arguments)

    def query(self, query: str, ticker: str | None = None, top_k: int = 3, strategy: str = "hybrid_rrf") -> dict:
        asked = self.spark.createDataFrame([(1, query)], "query_id int, text string")
        allow = None
        if ticker:
            fit = self.filings.where(F.col("ticker").isNull() | (F.upper("ticker") == ticker.strip().upper()))
            allow = self.chunks.join(fit.select("doc_id"), "doc_id", "left_semi").select("chunk_id")
        found = answer(asked, self.chunks, Settings(strategy=strategy, top_k=top_k), allow=allow)
        one = found["answers"].join(found["audited"], "query_id").select("text", models.fully_grounded(F.col("total_claims"), F.col("supported_claims")).alias("grounded"), "confidence").first()
        cited = grounding.ground_claims(found["claims"], found["hits"].join(self.chunks.select("chunk_id", "text"), "chunk_id").select("query_id", "chunk_id", "text"))
        cited = cited.orderBy(F.desc("confidence"), "claim_id", "chunk_id").limit(100)
        return {"answer": one["text"], "grounded": one["grounded"], "confidence": one["confidence"], "citations": [r.asDict(True) for r in cited.collect()], "cache_hit": False}

    def _filing(self, ticker: str, year: int, period: str) -> tuple[DataFrame, bool]:
        asked = self.spark.createDataFrame([(ticker.upper(), year, period)], "ticker string, year int, period string")
        first = catalog.by_period(self.filings, asked).where("doc_id is not null")
        found = self.filings.join(first.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
        if found.isEmpty():
            seed = sum(map(ord, f"{ticker.upper()}{year}{period}"))
            return synthetic.filings(self.spark, 1, seed).select(F.lit(f"{ticker.upper()}_{year}_{period}").alias("doc_id"), "text"), True
        return found, False

    def _tables(self, docs: DataFrame) -> DataFrame:
        return tables.extract_tables(docs).withColumn("table_id", F.concat_ws("_", "doc_id", "number"))

    def ratios(self, ticker: str, year: int = 2025, period: str = "Q3") -> dict:
        docs, made = self._filing(ticker, year, period)
        found = self._tables(docs)
        rows = statements.document_ratios(statements.table_ratios(found), found.select("table_id", "doc_id", F.col("number").alias("seq"))).collect()
        return (rows[0].asDict() if rows else {}) | {"synthetic": made}

    def compare(self, ticker: str, base_period: str = "Q2", compare_period: str = "Q3", year: int = 2025) -> dict:
        (base, one), (comp, two) = (self._filing(ticker, year, p) for p in (base_period, compare_period))
        side = lambda docs: tables.metrics(self._tables(docs)).withColumn("pos", F.struct("table_id", "row_idx", "col_idx"))
        rows = statements.compare_metrics(side(base), side(comp)).orderBy("pos").drop("pos").limit(10_000).collect()
        return {"ticker": ticker.upper(), "comparison": f"{base_period} vs {compare_period} {year}", "variances": [r.asDict(True) for r in rows], "synthetic": one or two}

    def audit(self, claims: list[str]) -> dict:
        asked = self.spark.createDataFrame(list(enumerate(claims)), "query_id int, text string")
        batch = answer(asked, self.chunks, Settings())["audit"].first()
        return {"passed": batch["compliance_status"] == "PASS", "total_claims": batch["total_claims"], "hallucination_rate": batch["hallucination_rate"], "unsupported_claims": batch["unsupported_claims"]}


def respond(tools: Tools, message: str) -> str | None:
    """One JSON-RPC message to its response; notifications (without an id) have none."""
    try:
        asked = json.loads(message)
    except ValueError:
        return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}})
    number, method, given = asked.get("id"), asked.get("method"), asked.get("params") or {}
    if number is None:
        return None
    try:
        if method == "initialize":
            result: dict = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "findoc", "version": "0.2"}}
        elif method == "tools/list":
            result = {"tools": schemas()}
        elif method == "tools/call":
            result = {"content": [{"type": "text", "text": json.dumps(tools.call(given["name"], given.get("arguments") or {}), default=str)}]}
        else:
            return json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"unknown method {method!r}"}})
    except (KeyError, TypeError, ValueError) as e:
        return json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": -32603, "message": str(e)}})
    return json.dumps({"jsonrpc": "2.0", "id": number, "result": result})
