"""Statement queries: orders become each nation's income statement and balance sheet, as markdown tables in texts.

The SQL works the same figures out from the orders, without any text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findoc.operators import statements as st
from findoc.operators import tables as tb
from findoc.plans import fixtures as fx
from findoc.plans.base import query, table

# Whole currency units from whole cents, so that both engines add up the same numbers.
_FACTS = """
SELECT n_nationkey, n_name, CAST(year(o_orderdate) AS INT) AS y, CAST(floor(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100) AS BIGINT) AS rev
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name, year(o_orderdate)"""

_WIDE = """
SELECT n_nationkey, n_name, max(CASE WHEN y = 1997 THEN rev END) AS cur, max(CASE WHEN y = 1996 THEN rev END) AS prior FROM ({facts}) GROUP BY n_nationkey, n_name HAVING max(CASE WHEN y = 1997 THEN rev END) > 0 AND max(CASE WHEN y = 1996 THEN rev END) > 0"""

_FACTS_SQL = _FACTS.format(orders="orders", customer="customer", nation="nation")
_SQL = f"f AS ({_WIDE.format(facts=_FACTS_SQL)}), v AS (SELECT n_nationkey AS k, c, x, x * 6 // 10 AS cogs, x - x * 6 // 10 AS gp, x // 5 AS op, x // 7 AS net, x * 2 AS assets, x AS liab, x // 2 AS ca, x // 3 AS cl, x // 9 AS cash, x // 11 AS ar, x // 4 AS debt FROM (SELECT n_nationkey, unnest([1, 2]) AS c, unnest([cur, prior]) AS x FROM f))"


def facts(spark, sf_dir) -> DataFrame:
    return spark.sql(_FACTS, **{name: table(spark, sf_dir, name) for name in ("orders", "customer", "nation")})


def statements(spark, sf_dir) -> DataFrame:
    """(table_id, doc_id, seq, text): two tables a nation, of this and the prior year."""
    wide = spark.sql(_WIDE.replace("({facts})", "{facts}"), facts=facts(spark, sf_dir))
    money = lambda x: F.concat(F.lit("$"), F.format_number(x, 0))
    part = lambda f: [f(F.col("cur")), f(F.col("prior"))]
    line = lambda label, f: F.concat(F.lit(f"| {label} | "), F.concat_ws(" | ", *[money(v) for v in part(f)]), F.lit(" |"))
    div = lambda n: lambda x: F.floor(x / n)
    head = "| Category | FY 2025 | FY 2024 |\n| --- | --- | --- |"
    income = F.concat_ws(
        "\n", F.concat(F.lit("**Table: Income Statement of "), F.col("n_name"), F.lit("**")), F.lit(head), line("Total Revenue", lambda x: x),
        line("Cost of Revenue", lambda x: F.floor(x * 6 / 10)), line("Gross Profit", lambda x: x - F.floor(x * 6 / 10)), line("Operating Income", div(5)), line("Net Income", div(7)), F.lit("* Unaudited"),
    )
    balance = F.concat_ws(
        "\n", F.concat(F.lit("**Table: Balance Sheet of "), F.col("n_name"), F.lit("**")), F.lit(head), line("Cash and Cash Equivalents", div(9)), line("Accounts Receivable", div(11)),
        line("Total Current Assets", div(2)), line("Total Assets", lambda x: x * 2), line("Total Current Liabilities", div(3)), line("Total Liabilities", lambda x: x), line("Total Debt", div(4)), line("Total Equity", lambda x: x),
    )
    both = wide.select("n_nationkey", F.posexplode(F.array(income, balance)).alias("seq", "text"))
    return both.select((F.col("n_nationkey") * 2 + F.col("seq")).alias("table_id"), F.col("n_nationkey").alias("doc_id"), "seq", "text")


def parsed(spark, sf_dir) -> DataFrame:
    return statements(spark, sf_dir).withColumn("table", tb.parse_markdown(F.col("text")))


_UNPIVOT = """SELECT k * 2 AS table_id, {cols} FROM v, (VALUES (0, 'Total Revenue'), (1, 'Cost of Revenue'), (2, 'Gross Profit'), (3, 'Operating Income'), (4, 'Net Income')) AS n(i, name)"""
_INCOME_ROWS = "SELECT k * 2 AS table_id, i AS row_idx, c AS col_idx, name, CASE i WHEN 0 THEN x WHEN 1 THEN cogs WHEN 2 THEN gp WHEN 3 THEN op ELSE net END AS value FROM v, (VALUES (0, 'Total Revenue'), (1, 'Cost of Revenue'), (2, 'Gross Profit'), (3, 'Operating Income'), (4, 'Net Income')) AS n(i, name)"
_BALANCE_ROWS = "SELECT k * 2 + 1 AS table_id, i AS row_idx, c AS col_idx, name, CASE i WHEN 0 THEN cash WHEN 1 THEN ar WHEN 2 THEN ca WHEN 3 THEN assets WHEN 4 THEN cl WHEN 5 THEN liab WHEN 6 THEN debt ELSE x END AS value FROM v, (VALUES (0, 'Cash and Cash Equivalents'), (1, 'Accounts Receivable'), (2, 'Total Current Assets'), (3, 'Total Assets'), (4, 'Total Current Liabilities'), (5, 'Total Liabilities'), (6, 'Total Debt'), (7, 'Total Equity')) AS n(i, name)"
_ROWS = f"r AS ({_INCOME_ROWS} UNION ALL {_BALANCE_ROWS})"


@query("markdown_table_unpivot", f"WITH {_SQL}, {_ROWS} SELECT table_id, row_idx, col_idx, name, 2026 - col_idx AS year, 'FY' AS period, value::DOUBLE AS value, 'USD' AS unit, 'thousands' AS scale, round(value * 1000.0, 6)::DOUBLE AS normalized FROM r")
def markdown_table_unpivot(spark, sf_dir):
    found = tb.metrics(parsed(spark, sf_dir))
    return found.select(F.col("table_id").cast("int").alias("table_id"), "row_idx", "col_idx", "name", "year", "period", "value", "unit", "scale", "normalized")


@query("table_headers", f"WITH {_SQL}, k AS (SELECT DISTINCT v.k, n_name FROM v JOIN nation ON n_nationkey = k) SELECT k * 2 AS table_id, 'Income Statement of ' || n_name AS title, 'income_statement' AS statement_type, 3 AS columns, 5 AS rows, 1 AS footnotes FROM k UNION ALL SELECT k * 2 + 1, 'Balance Sheet of ' || n_name, 'balance_sheet', 3, 8, 0 FROM k")
def table_headers(spark, sf_dir):
    t = F.col("table")
    return parsed(spark, sf_dir).select("table_id", "table.title", "table.statement_type", F.size(t["headers"]).alias("columns"), F.size(t["rows"]).alias("rows"), F.size(t["footnotes"]).alias("footnotes"))


@query("table_extract", f"WITH {_SQL} SELECT k AS doc_id, unnest([0, 1]) AS number, unnest([5, 8]) AS rows FROM (SELECT DISTINCT k FROM v)")
def table_extract(spark, sf_dir):
    """Both tables of a nation in one text, found again."""
    docs = statements(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n\nSome words.\n\n").alias("text"))
    return tb.extract_tables(docs).select("doc_id", "number", F.size("table.rows").alias("rows"))


@query("table_markdown_roundtrip", f"WITH {_SQL} SELECT k * 2 + s AS table_id, true AS equal FROM (SELECT DISTINCT k FROM v), (VALUES (0), (1)) AS t(s)")
def table_markdown_roundtrip(spark, sf_dir):
    again = parsed(spark, sf_dir).withColumn("again", tb.parse_markdown(tb.to_markdown(F.col("table"))))
    return again.select("table_id", (F.to_json("again.rows") == F.to_json("table.rows")).alias("equal"))


@query("table_records", f"WITH {_SQL}, {_ROWS} SELECT table_id, max(CASE WHEN col_idx = 1 THEN value END) AS current, max(CASE WHEN col_idx = 2 THEN value END) AS prior, name FROM r GROUP BY table_id, name")
def table_records(spark, sf_dir):
    records = parsed(spark, sf_dir).select("table_id", F.explode(tb.to_records(F.col("table"))).alias("m"))
    amount = lambda key: F.regexp_replace(F.element_at("m", key), "[$,]", "").cast("long")
    return records.select("table_id", amount("FY 2025").alias("current"), amount("FY 2024").alias("prior"), F.element_at("m", "Category").alias("name"))


@query("balance_reconcile", f"WITH {_SQL} SELECT k * 2 + 1 AS table_id, c AS col_idx, 'Total Assets == Total Liabilities + Stockholders'' Equity' AS equation, assets::DOUBLE AS expected_value, (liab + x)::DOUBLE AS actual_value, 0.0::DOUBLE AS difference, true AS is_balanced FROM v")
def balance_reconcile(spark, sf_dir):
    sheets = parsed(spark, sf_dir).where("seq = 1")
    both = [st.reconcile_balance(sheets, c).withColumn("col_idx", F.lit(c)) for c in (1, 2)]
    return both[0].unionByName(both[1])


@query("income_reconcile", f"WITH {_SQL} SELECT k * 2 AS table_id, 'Gross Profit == Revenue - COGS' AS equation, (x - cogs)::DOUBLE AS expected_value, gp::DOUBLE AS actual_value, 0.0::DOUBLE AS difference, true AS is_balanced FROM v WHERE c = 1")
def income_reconcile(spark, sf_dir):
    return st.reconcile_income(parsed(spark, sf_dir).where("seq = 0"))


_RATIOS_SQL = "round(gp / x * 100, 2) AS gross_margin_pct, round(op / x * 100, 2) AS operating_margin_pct, round(net / x * 100, 2) AS net_margin_pct"
_BALANCE_SQL = "round(ca / cl, 3) AS current_ratio, round((cash + ar) / cl, 3) AS quick_ratio, round(debt / x, 3) AS debt_to_equity, round(debt / assets, 3) AS debt_to_assets"


@query("ratios_by_table", f"WITH {_SQL} SELECT k * 2 AS table_id, {_RATIOS_SQL}, NULL::DOUBLE AS current_ratio, NULL::DOUBLE AS quick_ratio, NULL::DOUBLE AS debt_to_equity, NULL::DOUBLE AS debt_to_assets, NULL::DOUBLE AS return_on_equity_pct FROM v WHERE c = 1 UNION ALL SELECT k * 2 + 1, NULL, NULL, NULL, {_BALANCE_SQL}, NULL FROM v WHERE c = 1")
def ratios_by_table(spark, sf_dir):
    return st.table_ratios(parsed(spark, sf_dir))


@query("ratios_coalesced", f"WITH {_SQL} SELECT k AS doc_id, {_RATIOS_SQL}, {_BALANCE_SQL}, NULL::DOUBLE AS return_on_equity_pct FROM v WHERE c = 1")
def ratios_coalesced(spark, sf_dir):
    every = parsed(spark, sf_dir)
    return st.document_ratios(st.table_ratios(every), every.select("table_id", "doc_id", "seq"))


_VARIANCE = "round(b, 4)::DOUBLE AS base_value, round(c2, 4)::DOUBLE AS compare_value, round(c2 - b, 4)::DOUBLE AS absolute_change, CASE WHEN abs(c2 - b) < 1e-4 THEN 0.0 WHEN abs(b) > 1e-6 THEN round((c2 - b) / abs(b) * 100, 2) END::DOUBLE AS percentage_change, CASE WHEN abs(c2 - b) < 1e-4 THEN 'FLAT' WHEN c2 > b THEN 'UP' ELSE 'DOWN' END AS trend"


@query("variance_columns", f"WITH {_SQL}, {_ROWS} SELECT table_id, row_idx, name AS metric_name, 'USD' AS unit, {_VARIANCE} FROM (SELECT table_id, row_idx, name, max(CASE WHEN col_idx = 2 THEN value END) AS b, max(CASE WHEN col_idx = 1 THEN value END) AS c2 FROM r GROUP BY ALL)")
def variance_columns(spark, sf_dir):
    return st.compare_columns(parsed(spark, sf_dir))


@query("variance_yoy", f"SELECT n_name, y, {_VARIANCE} FROM (SELECT n_name, y, lag(rev) OVER (PARTITION BY n_name ORDER BY y) AS b, rev AS c2 FROM ({_FACTS_SQL})) WHERE b IS NOT NULL")
def variance_yoy(spark, sf_dir):
    return st.year_over_year(facts(spark, sf_dir).withColumn("rev", F.col("rev").cast("double")), ("n_name",), "y", "rev")


@query(
    "compare_documents",
    f"WITH {_SQL}, {_ROWS}, inc AS (SELECT table_id // 2 AS k, row_idx, col_idx, name, value FROM r WHERE table_id % 2 = 0) SELECT a.k AS pair_id, a.name AS metric_name, 'USD' AS unit, {_VARIANCE} FROM (SELECT c.k, c.name, b.value AS b, c.value AS c2 FROM inc c JOIN inc b ON b.k = c.k - 1 AND b.name = c.name AND b.col_idx = 2) a",
)
def compare_documents(spark, sf_dir):
    """Each nation's income statement against the one before it; of its columns the last is the base."""
    every = parsed(spark, sf_dir).where("seq = 0")
    pairs = every.select(F.col("doc_id").alias("pair_id"), (F.col("table_id") - 2).alias("base_id"), F.col("table_id").alias("compare_id"))
    return st.compare_documents(every, pairs).drop("pos")


_ISSUES = [
    (1, "| A | B |\n| --- | --- |\n| x | 1 |\n| y |\n|  |  |"),
    (2, "only words"),
    (3, "| Lonely |\n| a |"),
    (4, "| Margin | 2024 |\n| --- | --- |"),
    (5, "| Item | Amount |\n| --- | --- |\n| Gross margin | 120% |\n| Total Revenue | (500) |\n| Effective tax rate | 25% |\n| Net sales | 10 |"),
]


@query("table_structure_issues", f"SELECT * FROM {fx.values_sql([(1, 'ERROR', 'row 1 has 1 cells, the header 2', 1), (1, 'WARNING', '1 rows are empty', None), (2, 'ERROR', 'no header', None), (3, 'ERROR', 'no header', None), (3, 'x', 'x', None), (4, 'WARNING', 'no rows below the header', None)], 'table_id', 'severity', 'message', 'row_idx')} WHERE severity <> 'x' AND NOT (table_id = 3) UNION ALL SELECT 3, 'WARNING', '1 column: there is no value beside the label', NULL")
def table_structure_issues(spark, sf_dir):
    rows = fx.frame(spark, _ISSUES, "table_id int, text string").withColumn("table", tb.parse_markdown(F.col("text")))
    return tb.structure_issues(rows)


@query("numeric_bounds_issues", "SELECT 5 AS table_id, 'WARNING' AS severity, 'Gross margin' AS name, 120.0::DOUBLE AS value UNION ALL SELECT 5, 'ERROR', 'Total Revenue', -500.0")
def numeric_bounds_issues(spark, sf_dir):
    rows = fx.frame(spark, _ISSUES, "table_id int, text string").withColumn("table", tb.parse_markdown(F.col("text")))
    # a percent sign anywhere makes percent the table's scale, so the amounts are checked with the scale of their own
    return tb.bounds_issues(rows.withColumn("table", F.col("table").withField("scale", F.lit("thousands"))))


@query("find_metric_priority", "SELECT 120.0::DOUBLE AS current_assets, 500.0::DOUBLE AS total_assets, -300.0::DOUBLE AS liabilities, 200.0::DOUBLE AS equity, 45.0::DOUBLE AS cash, NULL::DOUBLE AS goodwill")
def find_metric_priority(spark, sf_dir):
    text = "| Item | Now | Then |\n| --- | --- | --- |\n" + "\n".join("| " + " | ".join(r) + " |" for r in fx.LOOKUP_TABLE)
    rows = fx.frame(spark, [(1, text)], "table_id int, text string").withColumn("table", tb.parse_markdown(F.col("text")))
    asked = {"current_assets": ("total current assets", "current assets"), "total_assets": ("total assets", "assets"), "liabilities": ("total liabilities", "liabilities"), "equity": ("total stockholders' equity", "total equity", "equity"), "cash": ("cash and cash equivalents", "cash"), "goodwill": ("goodwill",)}
    return tb.find_values(rows, asked).drop("table_id")


@query("delimited_tables", "SELECT 1 AS id, 3 AS columns, 'Line Item|FY2024|FY2025' AS headers, 'Revenue, net|1,000|1100;Cost|5|6' AS rows UNION ALL SELECT 2, 0, '', ''")
def delimited_tables(spark, sf_dir):
    rows = fx.frame(spark, [(1, 'Line Item,FY2024,FY2025\n"Revenue, net","1,000",1100\n , ,\nCost, 5 ,6'), (2, " ")], "id int, text string")
    t = tb.parse_delimited(F.col("text"))
    return rows.select("id", F.size(t["headers"]).alias("columns"), F.array_join(t["headers"], "|").alias("headers"), F.array_join(F.transform(t["rows"], lambda r: F.array_join(r, "|")), ";").alias("rows"))
