"""Tables in texts: parsing, scale and statement type, unpivoting to cells and metrics, rendering, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findoc.functions.cleaning import stripped
from findoc.functions.finance import parse_amount

# Words that decide scale, currency and statement type, in order.
TABLE_SCALES = [("billions", ("billion", "$b")), ("millions", ("million", "$m")), ("thousands", ("thousand", "$k")), ("percent", ("%", "percent"))]
TABLE_UNITS = [("USD", ("$", "usd", "dollar")), ("EUR", ("€", "eur")), ("GBP", ("£", "gbp", "pound")), ("JPY", ("¥", "jpy", "yen", "cny")), ("CHF", ("chf",)), ("CAD", ("cad",)), ("AUD", ("aud",))]
STATEMENTS = [
    ("income_statement", ("operations", "income statement", "statement of earnings", "operating income", "gross profit", "cost of sales", "diluted earnings per share")),
    ("comprehensive_income", ("comprehensive income", "other comprehensive", "foreign currency translation")),
    ("stockholders_equity", ("statement of equity", "stockholders' equity", "shareholders' equity", "common stock", "treasury stock")),
    ("cash_flow", ("cash flow", "operating activities", "investing activities", "financing activities", "capital expenditures", "depreciation and amortization")),
    ("balance_sheet", ("balance sheet", "financial position", "total assets", "current liabilities", "retained earnings", "accounts receivable")),
    ("segment_metrics", ("segment", "geographic", "americas", "europe", "asia pacific", "greater china")),
    ("notes", ("note", "accounting policies")),
]
SEPARATOR = r"^\|?(\s*:?-+:?\s*\|)+\s*:?-+:?\s*\|?$"
BLANKS = ("", "-", "—", "N/A", "n/a", "nil")


def first_of(text: Column, choices: list[tuple[str, tuple[str, ...]]], default: str | None = None) -> Column:
    """The first choice of which a word is in the text."""
    out = F.lit(default)
    for name, words in reversed(choices):
        out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), name).otherwise(out)
    return out


def parse_markdown(text: Column) -> Column:
    """struct(title, headers, rows, footnotes, scale, unit, statement_type) of a markdown table with lines around it."""
    lines = F.filter(F.transform(F.split(stripped(text), "\n"), stripped), lambda x: x != "")

    def kind(x: Column) -> Column:
        starts = lambda *names: x.rlike("^(?:" + "|".join(names) + ")")
        return F.when(starts(r"\*\*Table:", "### Table", "# Table"), "title").when(starts(r"\*", r"\(1\)", r"\(2\)", "Note:"), "note").when(x.rlike(SEPARATOR), "rule").when(F.contains(x, F.lit("|")), "row").otherwise("other")

    tagged = F.transform(lines, lambda x, i: F.struct(kind(x).alias("kind"), x.alias("line"), i.alias("at")))
    rows = F.filter(tagged, lambda x: x["kind"] == "row")
    first = F.coalesce(F.try_element_at(rows, F.lit(1))["at"], F.lit(1 << 30))
    named = F.filter(tagged, lambda x: (x["kind"] == "title") | ((x["kind"] == "other") & (x["at"] < first)))
    top = F.try_element_at(named, F.lit(1))
    title = F.when(top["kind"] == "title", stripped(F.replace(F.regexp_replace(top["line"], r"^[*#]+|[*#]+$", ""), F.lit("Table:"), F.lit("")))).otherwise(top["line"])
    cells = F.transform(rows, lambda x: F.transform(F.split(F.regexp_replace(x["line"], r"^\|+|\|+$", ""), r"\|"), stripped))
    headers = F.coalesce(F.try_element_at(cells, F.lit(1)), F.array().cast("array<string>"))
    body = F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1)))
    notes = F.transform(F.filter(tagged, lambda x: x["kind"] == "note"), lambda x: x["line"])
    low = F.lower(text)
    corpus = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.array_join(headers, " "), F.array_join(F.transform(body, lambda r: F.try_element_at(r, F.lit(1))), " ")))
    return F.struct(
        title.alias("title"), headers.alias("headers"), body.alias("rows"), notes.alias("footnotes"), first_of(low, TABLE_SCALES, "thousands").alias("scale"),
        first_of(low, TABLE_UNITS, "USD").alias("unit"), first_of(corpus, STATEMENTS, "unknown").alias("statement_type"),
    )


def parse_delimited(text: Column, delimiter: str = ",") -> Column:
    """struct(headers, rows) of delimited lines; quoted fields may hold the delimiter but no line end."""
    lines = F.filter(F.split(stripped(text), "\r?\n"), lambda x: F.regexp_replace(x, f"[{delimiter}\\s\"]", "") != "")
    field = rf'(?:^|{delimiter})(?:"((?:[^"]|"")*)"|([^{delimiter}]*))'
    cells = F.transform(lines, lambda x: F.zip_with(F.regexp_extract_all(x, F.lit(field), F.lit(1)), F.regexp_extract_all(x, F.lit(field), F.lit(2)), lambda q, p: stripped(F.when(q != "", F.replace(q, F.lit('""'), F.lit('"'))).otherwise(p))))
    return F.struct(F.coalesce(F.try_element_at(cells, F.lit(1)), F.array().cast("array<string>")).alias("headers"), F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))).alias("rows"))


def extract_tables(docs: DataFrame) -> DataFrame:
    """(doc_id, number, table) for each run of pipe lines in (doc_id, text), with a title line above it if there is one."""
    pattern = r"((?:(?:\*\*Table:[^\n]+\*\*|###\s*Table[^\n]+)\r?\n)?(?:[ \t]*\|[^\n]+\|(?:\r?\n|$))+)"
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(1))).alias("number", "block"))
    return found.select("doc_id", "number", parse_markdown(F.col("block")).alias("table")).where(F.size("table.headers") > 0)


def cells(tables: DataFrame) -> DataFrame:
    """(table_id, row_idx, label, col_idx, header, raw) of (table_id, table): every cell right of the labels."""
    rows = tables.select("table_id", "table.headers", F.posexplode("table.rows").alias("row_idx", "row"))
    long = rows.select("table_id", "headers", "row_idx", F.try_element_at("row", F.lit(1)).alias("label"), F.posexplode("row").alias("col_idx", "raw"))
    return long.where("col_idx >= 1").select("table_id", "row_idx", "label", "col_idx", F.get("headers", F.col("col_idx")).alias("header"), "raw")


def metrics(tables: DataFrame) -> DataFrame:
    """(table_id, row_idx, col_idx, name, raw, year, period, value, unit, scale, normalized) of the cells that hold amounts."""
    info = tables.select("table_id", "table.unit", "table.scale")
    kept = cells(tables).where(F.col("header").isNotNull()).withColumns({"name": stripped(F.col("label")), "raw": stripped(F.col("raw")), "head": stripped(F.col("header"))})
    kept = kept.where(~F.col("raw").isin(*BLANKS) & (F.col("name") != "") & ~F.col("name").startswith("---")).join(info, "table_id")
    found = kept.withColumn("a", parse_amount(F.col("raw"), F.col("unit"), F.col("scale")))
    first = lambda pattern: F.nullif(F.regexp_extract("head", pattern, 1), F.lit(""))
    year, period = first(r"\b(20[0-9]{2}|19[0-9]{2})\b").cast("int"), F.upper(first(r"(?i)\b(Q[1-4]|FY|FY[0-9]{2,4})\b"))
    return found.select("table_id", "row_idx", "col_idx", "name", "raw", year.alias("year"), period.alias("period"), "a.value", "a.unit", "a.scale", "a.normalized")


def find_values(tables: DataFrame, lookups: dict[str, tuple[str, ...]], col_idx: int = 1) -> DataFrame:
    """(table_id, one column for each lookup): the first amount in a column whose label is a keyword, or else holds one.

    Keywords go in order; an exact label comes before any label that merely holds one; totals of assets and liabilities
    are not looked for in labels with 'current'. One aggregation answers all lookups of all tables.
    """
    rows = tables.select("table_id", F.posexplode("table.rows").alias("row_idx", "row")).select("table_id", "row_idx", F.lower(stripped(F.try_element_at("row", F.lit(1)))).alias("label"), F.get("row", F.lit(col_idx)).alias("raw"))
    rows = rows.withColumn("value", parse_amount(F.col("raw"))["value"]).where(F.col("value").isNotNull())
    totals = {"total assets", "assets", "total liabilities", "liabilities"}
    picks = []
    for name, keywords in lookups.items():
        place = F.lit(None).cast("int")
        for k, word in reversed(list(enumerate(keywords))):
            inside = F.contains(F.col("label"), F.lit(word))
            if word in totals:
                inside &= ~F.contains(F.col("label"), F.lit("current"))
            place = F.when(inside, 100 + k).otherwise(place)
        for k, word in reversed(list(enumerate(keywords))):
            place = F.when(F.col("label") == word, k).otherwise(place)
        picks.append(F.min(F.when(place.isNotNull(), F.struct(place.alias("place"), F.col("row_idx"), F.col("value"))))["value"].alias(name))
    return tables.select("table_id").join(rows.groupBy("table_id").agg(*picks), "table_id", "left")


def to_markdown(table: Column) -> Column:
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform(table["rows"], line)
    head = F.when(F.size(table["headers"]) > 0, F.array(line(table["headers"]), line(F.transform(table["headers"], lambda _: F.lit("---"))))).otherwise(F.array().cast("array<string>"))
    title = F.when(table["title"].isNotNull(), F.array(F.concat(F.lit("**Table: "), table["title"], F.lit("**")))).otherwise(F.array().cast("array<string>"))
    notes = F.when(F.size(table["footnotes"]) > 0, F.concat(F.array(F.lit("")), F.transform(table["footnotes"], lambda n: F.concat(F.lit("* "), n)))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(title, head, body, notes), "\n")


def to_records(table: Column) -> Column:
    """array<map<header, cell>>; missing cells are empty."""
    return F.transform(table["rows"], lambda r: F.map_from_arrays(table["headers"], F.transform(table["headers"], lambda h, i: F.coalesce(F.get(r, i), F.lit("")))))


def column_values(table: Column, name: str) -> Column:
    """The cells below a header (in any case); an empty array for an unknown one."""
    at = F.array_position(F.transform(table["headers"], lambda h: F.lower(stripped(h))), name.strip().lower()).cast("int")
    return F.when(at == 0, F.array().cast("array<string>")).otherwise(F.transform(table["rows"], lambda r: F.coalesce(F.get(r, at - 1), F.lit(""))))


def structure_issues(tables: DataFrame) -> DataFrame:
    """(table_id, severity, message, row_idx) of tables without headers, with ragged, no or empty rows, or one column."""
    headers, rows = F.col("table.headers"), F.col("table.rows")
    n = F.size(headers)
    issue = lambda severity, message, at=None: F.struct(F.lit(severity).alias("severity"), message.alias("message"), (F.lit(None).cast("int") if at is None else at).alias("row_idx"))
    ragged = F.filter(F.transform(rows, lambda r, i: F.when(F.size(r) != n, issue("ERROR", F.format_string("row %d has %d cells, the header %d", i, F.size(r), n), i))), lambda x: x.isNotNull())
    empty = F.size(F.filter(rows, lambda r: F.forall(r, lambda c: stripped(c) == "")))
    others = F.array_compact(F.array(
        F.when(n < 2, issue("WARNING", F.format_string("%d column: there is no value beside the label", n))),
        F.when(F.size(rows) == 0, issue("WARNING", F.lit("no rows below the header"))),
        F.when(empty > 0, issue("WARNING", F.format_string("%d rows are empty", empty))),
    ))
    every = F.when(n == 0, F.array(issue("ERROR", F.lit("no header")))).otherwise(F.concat(others, ragged))
    return tables.select("table_id", F.explode(every).alias("i")).select("table_id", "i.severity", "i.message", "i.row_idx")


def bounds_issues(tables: DataFrame) -> DataFrame:
    """(table_id, severity, name, value): margins and tax rates above 100 %, negative totals that cannot be."""
    found = metrics(tables).where(F.col("value").isNotNull()).withColumn("low", F.lower("name"))
    share = (F.col("scale") == "percent") | F.contains(F.col("raw"), F.lit("%"))
    above = share & (F.col("value") > 100) & (F.contains(F.col("low"), F.lit("margin")) | F.contains(F.col("low"), F.lit("tax rate")))
    totals = F.exists(F.array(*map(F.lit, ("total revenue", "net sales", "total assets", "cash and cash equivalents"))), lambda w: F.contains(F.col("low"), w))
    severity = F.when(above, "WARNING").when(~share & totals & (F.col("value") < 0), "ERROR")
    return found.withColumn("severity", severity).where(F.col("severity").isNotNull()).select("table_id", "severity", "name", "value")
