"""Statement analytics over many tables at once: reconciliation, ratios, variances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findoc.functions.finance import parse_amount, variance
from findoc.operators.tables import find_values, metrics

# Labels to look for, in order.
BALANCE = {
    "total_assets": ("total assets", "assets"), "total_liabilities": ("total liabilities", "liabilities"),
    "stockholders_equity": ("total stockholders' equity", "total shareholders' equity", "total equity", "equity"),
    "total_liabilities_and_equity": ("total liabilities and stockholders' equity", "total liabilities and equity"),
}
INCOME = {
    "revenue": ("total revenue", "revenue", "net sales", "sales"), "cogs": ("cost of revenue", "cost of goods sold", "cogs", "cost of sales"),
    "gross_profit": ("gross profit", "gross margin"),
}
RATIO_INPUTS = {
    "revenue": ("total revenue", "revenue", "net sales"), "gross_profit": ("gross profit", "gross margin"), "operating_income": ("operating income", "operating profit"),
    "net_income": ("net income", "net earnings"), "current_assets": ("total current assets", "current assets"), "current_liabilities": ("total current liabilities", "current liabilities"),
    "cash": ("cash and cash equivalents", "cash"), "securities": ("marketable securities", "short-term investments"), "receivables": ("accounts receivable", "receivables"),
    "debt": ("total debt", "long-term debt"), "equity": ("total stockholders' equity", "total shareholders' equity", "total equity"), "assets": ("total assets",),
}
RATIOS = ("gross_margin_pct", "operating_margin_pct", "net_margin_pct", "current_ratio", "quick_ratio", "debt_to_equity", "debt_to_assets", "return_on_equity_pct")


def reconcile_balance(tables: DataFrame, col_idx: int = 1, tolerance: float = 1.0) -> DataFrame:
    """(table_id, equation, expected_value, actual_value, difference, is_balanced): assets against liabilities and equity."""
    v = find_values(tables, BALANCE, col_idx)
    a, l, e, both = (F.col(c) for c in BALANCE)
    summed = l.isNotNull() & e.isNotNull()
    actual = F.when(a.isNull(), 0.0).when(both.isNotNull(), both).when(summed, l + e).otherwise(0.0)
    known = a.isNotNull() & (both.isNotNull() | summed)
    diff = F.when(a.isNull(), 0.0).when(known, F.abs(a - actual)).otherwise(a)
    equation = F.when(a.isNull(), "Assets = Liabilities + Equity").when(both.isNotNull(), "Total Assets == Total Liabilities and Equity").when(summed, "Total Assets == Total Liabilities + Stockholders' Equity").otherwise("Assets = Liabilities + Equity")
    return v.select("table_id", equation.alias("equation"), F.coalesce(a, F.lit(0.0)).alias("expected_value"), actual.alias("actual_value"), F.round(diff, 4).alias("difference"), (known & (diff <= tolerance)).alias("is_balanced"))


def reconcile_income(tables: DataFrame, col_idx: int = 1, tolerance: float = 1.0) -> DataFrame:
    """(table_id, equation, expected_value, actual_value, difference, is_balanced): gross profit against revenue less costs."""
    v = find_values(tables, INCOME, col_idx)
    r, c, g = (F.col(x) for x in INCOME)
    known = r.isNotNull() & c.isNotNull() & g.isNotNull()
    expected, actual = F.when(known, r - F.abs(c)).otherwise(0.0), F.when(known, g).otherwise(0.0)
    diff = F.abs(actual - expected)
    return v.select("table_id", F.lit("Gross Profit == Revenue - COGS").alias("equation"), expected.alias("expected_value"), actual.alias("actual_value"), F.round(diff, 4).alias("difference"), (known & (diff <= tolerance)).alias("is_balanced"))


def margins(revenue: Column, **parts: Column) -> dict[str, Column]:
    """Percentages of a positive revenue, null otherwise."""
    return {name: F.when(revenue > 0, F.round(part / revenue * 100.0, 2)) for name, part in parts.items()}


def liquidity(assets: Column, liabilities: Column, *quick: Column) -> dict[str, Column]:
    """current_ratio and quick_ratio (of the parts that are known) for positive liabilities, null otherwise."""
    known = F.lit(False)
    total = F.lit(0.0)
    for part in quick:
        known |= part.isNotNull()
        total += F.coalesce(part, F.lit(0.0))
    return {"current_ratio": F.when(liabilities > 0, F.round(assets / liabilities, 3)), "quick_ratio": F.when(assets.isNotNull() & (liabilities > 0) & known, F.round(total / liabilities, 3))}


def solvency(debt: Column, equity: Column, assets: Column) -> dict[str, Column]:
    return {"debt_to_equity": F.when(equity > 0, F.round(debt / equity, 3)), "debt_to_assets": F.when(assets > 0, F.round(debt / assets, 3))}


def table_ratios(tables: DataFrame, col_idx: int = 1) -> DataFrame:
    """(table_id, RATIOS): null where a table lacks what a ratio needs."""
    v = find_values(tables, RATIO_INPUTS, col_idx)
    c = {name: F.col(name) for name in RATIO_INPUTS}
    out = margins(c["revenue"], gross_margin_pct=c["gross_profit"], operating_margin_pct=c["operating_income"], net_margin_pct=c["net_income"])
    out |= liquidity(c["current_assets"], c["current_liabilities"], c["cash"], c["securities"], c["receivables"])
    solid = c["debt"].isNotNull() & (c["equity"] > 0)
    out |= {name: F.when(solid, value) for name, value in solvency(c["debt"], c["equity"], c["assets"]).items()}
    out["return_on_equity_pct"] = F.when(c["equity"] > 0, F.round(c["net_income"] / c["equity"] * 100.0, 2))
    return v.select("table_id", *[out[name].alias(name) for name in RATIOS])


def document_ratios(ratios: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, RATIOS): of a document's tables, in order, the first that has a ratio. ``places``: (table_id, doc_id, seq)."""
    rows = ratios.join(places, "table_id")
    return rows.groupBy("doc_id").agg(*[F.min(F.when(F.col(name).isNotNull(), F.struct("seq", F.col(name).alias("v"))))["v"].alias(name) for name in RATIOS])


def compare_metrics(base: DataFrame, compare: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Variances of the metrics in ``compare`` whose name ``base`` has: keys, metric_name, unit and the variance.

    Both are (keys, pos, name, raw, value, unit, scale). Names match in any case; of equal names in ``base`` the last
    counts, in ``compare`` each.
    """
    name = F.lower(F.trim("name"))
    known = base.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*keys, name.alias("key")).agg(F.max_by("value", "pos").alias("base"))
    rows = compare.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("key", name).join(known, [*keys, "key"])
    unit = F.when((F.col("scale") == "percent") | F.contains(F.col("raw"), F.lit("%")), "%").otherwise(F.col("unit"))
    return rows.select(*keys, "pos", F.col("name").alias("metric_name"), unit.alias("unit"), variance(F.col("base"), F.col("value")).alias("v")).select(*keys, "pos", "metric_name", "unit", "v.*")


def compare_columns(tables: DataFrame, base_col: int = 2, compare_col: int = 1) -> DataFrame:
    """(table_id, row_idx, metric_name, unit and the variance) of two columns of each table that has both."""
    rows = tables.where(F.size("table.headers") > max(base_col, compare_col)).select("table_id", F.col("table.unit").alias("unit"), F.posexplode("table.rows").alias("row_idx", "row"))
    rows = rows.select("table_id", "unit", "row_idx", F.trim(F.get("row", F.lit(0))).alias("metric_name"), F.get("row", F.lit(base_col)).alias("b"), F.get("row", F.lit(compare_col)).alias("c"))
    rows = rows.withColumns({"base": parse_amount(F.col("b")), "comp": parse_amount(F.col("c"))}).where("base.value is not null and comp.value is not null")
    unit = F.when((F.col("comp.scale") == "percent") | F.contains(F.col("c"), F.lit("%")), "%").otherwise(F.coalesce("unit", F.lit("USD")))
    return rows.select("table_id", "row_idx", "metric_name", unit.alias("unit"), variance(F.col("base.value"), F.col("comp.value")).alias("v")).select("table_id", "row_idx", "metric_name", "unit", "v.*")


def compare_documents(tables: DataFrame, pairs: DataFrame) -> DataFrame:
    """Variances between the tables of documents. ``pairs``: (pair_id, base_id, compare_id), ids of tables."""
    rows = metrics(tables).withColumn("pos", F.struct("row_idx", "col_idx"))
    side = lambda key: pairs.select("pair_id", F.col(key).alias("table_id")).join(rows, "table_id").drop("table_id")
    return compare_metrics(side("base_id"), side("compare_id"), ("pair_id",))


def year_over_year(facts: DataFrame, keys: tuple[str, ...], order: str, value: str) -> DataFrame:
    """Each period's ``value`` against the one before it, within ``keys``."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return facts.withColumn("_base", before).where(F.col("_base").isNotNull()).select(*keys, order, variance(F.col("_base"), F.col(value)).alias("v")).select(*keys, order, "v.*")
