"""Synthetic filings for trials: statements that balance by construction, from a seed and a range of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def filings(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """(doc_id, ticker, year, period, revenue, text) of ``n`` filings; equal seeds give equal filings."""
    draw = lambda salt, low, high: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(high - low + 1)) + low).cast("long")
    rows = spark.range(n).withColumns({"revenue": draw(1, 1_000, 90_000), "cost": draw(2, 30, 70), "year": draw(3, 2019, 2025).cast("int"), "quarter": draw(4, 1, 4), "share": draw(5, 20, 80)})
    rows = rows.withColumns({"cogs": F.floor(F.col("revenue") * F.col("cost") / 100), "assets": F.col("revenue") * 3}).withColumn("liabilities", F.floor(F.col("assets") * F.col("share") / 100))
    ticker = F.concat(F.lit("S"), F.conv(F.pmod("id", F.lit(46656)).cast("string"), 10, 36))
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    line = lambda label, c: F.concat(F.lit(f"| {label} | "), money(c), F.lit(" |\n"))
    head = F.lit(" (in millions)**\n| Item | Amount |\n| --- | --- |\n")
    text = F.concat(
        F.lit("NASDAQ: "), ticker, F.lit("\nForm 10-Q, Q"), F.col("quarter").cast("string"), F.lit(" "), F.col("year").cast("string"), F.lit("\n\nITEM 1. FINANCIAL STATEMENTS\n\n**Table: Income Statement"), head,
        line("Total Revenue", F.col("revenue")), line("Cost of Revenue", F.col("cogs")), line("Gross Profit", F.col("revenue") - F.col("cogs")), F.lit("\n**Table: Balance Sheet"), head, line("Total Assets", F.col("assets")),
        line("Total Liabilities", F.col("liabilities")), line("Total Equity", F.col("assets") - F.col("liabilities")), F.lit("\nITEM 1A. RISK FACTORS\n\nDemand may fall."),
    )
    return rows.select(F.concat(F.lower(ticker), F.lit("_10-q_"), F.col("year").cast("string"), F.lit("_q"), F.col("quarter").cast("string"), F.lit("_"), F.col("id").cast("string")).alias("doc_id"), ticker.alias("ticker"), "year", F.concat(F.lit("Q"), F.col("quarter").cast("string")).alias("period"), "revenue", text.alias("text"))
