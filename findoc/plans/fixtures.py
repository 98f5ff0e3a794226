"""Small literal inputs for operators whose inputs the tables lack, for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILINGS = [
    (1, "ACME CORP\nNASDAQ: ACME\nForm 10-K for the fiscal year ended December 31, 2024\n\nITEM 1. BUSINESS\nAcme makes sensors for factories.\n\nITEM 1A. RISK FACTORS\nSupply of copper is uncertain.\n\nCompetition may reduce prices.\n\nITEM 7. MANAGEMENT'S DISCUSSION AND ANALYSIS\nTotal revenue was $1,250 million and operating income reached $310 million.\n\nRevenue: $1250 million\n\nFigure 1: Revenue by segment\n- Sensors: $700M\n- Services: 550\nx-axis: Segment\n\n| Item | 2024 | 2023 |\n| --- | --- | --- |\n| Total Revenue | $1,250 | $1,100 |"),
    (2, "Press release\nSymbol (GLBX) Q3 2025 results\n\nHIGHLIGHTS:\nNet income of 45 million, margin increased to 12.5%\n\nOUTLOOK\nGuidance is unchanged."),
    (3, "A plain note without any heading.\n\nIt has two paragraphs."),
    (4, "  \n\n "),
    (5, "Item 2. Properties\nWe own one plant.\n\nItem 3. Legal Proceedings\nNone.\n\nItem 8. Financial Statements\nSee the tables."),
]

RAW_AMOUNTS = ["$94.9B", "(150.5M)", "-$45.2B", "42.5%", "€500M", "¥3,500", "N/A", "(45.2)%", "$-5", "12 percent", "10-15", "1.2.3", "£7k", "", "  $1,250M ", "(1,234.5)", "3 trillion", "-7", "2.5 billion", "750 thousand", "."]

SCALE_WORDS = ["ones", "Thousands", " millions ", "B", "t", "%", "percent", "bps", "ratio", "dozens", "", "basis_points"]

MESSY = [
    (1, "<TYPE>10-K\n<DOCUMENT><p>Loss of ($1,234.5) and (12.5%) or ( 500 ) &amp; more</p>\n\n\n\n\nTable of Contents\nPage 12 of 90 \n\nNet—sales “up” &nbsp;5&#160;% − fine   \n</DOCUMENT>"),
    (2, "No tags here"),
    (3, ""),
    (4, "<b>bold</b> &lt;gone&gt; it’s\n\n\n\nend"),
]

CELLS = [(1, "Revenue [1]"), (2, "Cost (a)"), (3, "1,234*"), (4, " plain "), (5, "x †‡"), (6, "Net [12] (b) **")]

RAGGED = [
    (1, "| A | B | C |\n| --- | --- |\n| 1 | 2 |\n| x [1] | y (a) | 3* |"),
    (2, "no table"),
    (3, "| A |\n|:--|\n| 1 |\nnote below"),
    (4, ""),
]

FIGURES = [
    (1, "Figure 2: Revenue mix by segment in millions\n- Cloud: $450.0M\n- Hardware: 1,250.5\n* Services: 94.2\nx-axis: Segment, y-axis: USD"),
    (2, "Chart: quarterly trend\nQ1: 10\nQ2: 12\nQ1: 11"),
    (3, "[Figure 7: Cash bridge] opening: 5 closing: 9"),
    (4, "A pie without numbers"),
]

QUESTIONS = [
    (1, "Compare AAPL versus MSFT revenue in Q3 2025"), (2, "What is the growth rate of operating margin for FY2024?"), (3, "Describe litigation risk for TSLA in the 10-K"),
    (4, "What was NVDA diluted EPS?"), (5, "Hello there"), (6, "show annual cash flow 1999 and 2001"), (7, "Summarise the press release of H2 by IBM"), (8, "strategy of (GOOG) outlook"),
]

LOOKUP_TABLE = [
    ("Current Assets", "100", "90"), ("Total Current Assets", "120", "95"), ("Total Assets", "500", "450"), ("Current Liabilities", "80", "70"), ("Total Liabilities", "(300)", "250"),
    ("Stockholders' Equity", "n/a", "10"), ("Total Equity", "$200M", "180"), ("Cash", "", "3"), ("Cash and Cash Equivalents", "45", "40"),
]


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def values_sql(rows: list, *columns: str) -> str:
    def literal(v):
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(literal(v) for v in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(columns)}))"
