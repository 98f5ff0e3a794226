"""Company facts (JSON by concept and unit) to filing texts; a source of its own only where a network is there."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registry numbers of known companies.
KNOWN_CIKS = {"AAPL": "0000320193", "MSFT": "0000789019", "TSLA": "0001318605", "NVDA": "0001045810", "AMZN": "0001018724", "GOOGL": "0001652044", "META": "0001326801", "ACM": "0001786523"}

_CONCEPT = "struct<units:struct<USD:array<struct<val:double>>>>"
FACTS = f"entityName string, facts struct<`us-gaap`:struct<Revenues:{_CONCEPT},OperatingIncomeLoss:{_CONCEPT},NetIncomeLoss:{_CONCEPT}>>"


def cik(ticker: Column) -> Column:
    """A ticker's registry number; unknown ones get a number made from a checksum, the same on every machine."""
    known = F.create_map(*[F.lit(x) for kv in KNOWN_CIKS.items() for x in kv])
    made = F.lpad((F.pmod(F.crc32(F.upper(ticker).cast("binary")), F.lit(9_000_000)) + 1_000_000).cast("string"), 10, "0")
    return F.coalesce(F.try_element_at(known, F.upper(ticker)), made)


#: The concepts and what stands in for them where no facts can be had.
FALLBACK = {"Revenues": 94_900_000_000, "OperatingIncomeLoss": 29_600_000_000, "NetIncomeLoss": 21_400_000_000}
ADDRESS = "https://data.sec.gov/api/xbrl/companyfacts/CIK{cik}.json"


def fallback_facts(ticker: str, number: str) -> str:
    """Facts of the usual shape for a ticker, as JSON."""
    concepts = {name: {"units": {"USD": [{"end": "2025-06-30", "val": value, "fy": 2025, "fp": "Q3", "form": "10-Q"}]}} for name, value in FALLBACK.items()}
    return json.dumps({"cik": int(number), "entityName": f"{ticker.upper()} INC.", "facts": {"us-gaap": concepts}})


def download(number: str, agent: str, timeout_s: float = 10.0) -> str:
    """The facts of a registry number, as JSON, from the public address."""
    request = urllib.request.Request(ADDRESS.format(cik=number), headers={"User-Agent": agent})
    with urllib.request.urlopen(request, timeout=timeout_s) as answer:  # noqa: S310
        return answer.read().decode("utf-8", "replace")


def company_facts(tickers: DataFrame, fetch: Callable[[str], str] | None = None, pause_s: float = 0.15, tasks: int = 1) -> DataFrame:
    """(ticker, year, period) with json and ``source``: fetched by registry number, or the fallback where that fails.

    ``fetch`` maps a registry number to JSON (``download`` with an agent's name, say); without it nothing is fetched. A task
    waits ``pause_s`` between two calls, and there are ``tasks`` of them, so the rate is bounded.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found, source = [], []
            for ticker, number in zip(rows["ticker"], rows["cik"], strict=True):
                text = None
                if fetch:
                    time.sleep(pause_s)
                    try:
                        text = fetch(number)
                        json.loads(text)
                    except Exception:  # a missing answer is no reason to stop
                        text = None
                found.append(text or fallback_facts(ticker, number))
                source.append("fetched" if text else "fallback")
            yield rows.assign(json=found, source=source).drop(columns="cik")

    kinds = dict(tickers.dtypes)
    rows = tickers.select("ticker", "year", "period", cik(F.col("ticker")).alias("cik")).repartition(tasks)
    return rows.mapInPandas(run, f"ticker string, year {kinds['year']}, period string, json string, source string")


def facts_to_filings(rows: DataFrame) -> DataFrame:
    """(doc_id, ticker, year, period, doc_type, text) of (ticker, year, period, json): the last value of three concepts, in a quarterly report."""
    parsed = rows.withColumn("f", F.from_json("json", FACTS))
    last = lambda name: F.coalesce(F.try_element_at(F.col(f"f.facts.`us-gaap`.{name}.units.USD"), F.lit(-1))["val"], F.lit(0.0))
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    t, entity = F.upper("ticker"), F.coalesce(F.col("f.entityName"), F.concat(F.upper("ticker"), F.lit(" Corp")))
    when = F.concat_ws(" ", "period", F.col("year").cast("string"))
    text = F.concat(
        F.lit("QUARTERLY REPORT (FORM 10-Q)\n\nCompany: "), entity, F.lit(" (Ticker: "), t, F.lit(")\nFiscal Period: "), when,
        F.lit("\n\nITEM 1. FINANCIAL STATEMENTS\n\n| Metric | Amount (USD) |\n| :--- | :--- |\n| Total Net Revenues | "), money(last("Revenues")), F.lit(" |\n| Operating Income | "), money(last("OperatingIncomeLoss")),
        F.lit(" |\n| Net Income | "), money(last("NetIncomeLoss")), F.lit(" |\n\nITEM 1A. RISK FACTORS\n\nMarket, currency and regulatory risks could affect "), t,
        F.lit(".\n\nITEM 7. MANAGEMENT'S DISCUSSION AND ANALYSIS\n\nIn "), when, F.lit(", "), entity, F.lit(" had total net revenues of "), money(last("Revenues")), F.lit("."),
    )
    return parsed.select(F.concat_ws("_", t, F.col("year").cast("string"), "period", F.lit("SEC")).alias("doc_id"), t.alias("ticker"), "year", "period", F.lit("10-Q").alias("doc_type"), text.alias("text"))
