"""From texts to chunks: paragraphs, sections, modalities, word windows, packed section chunks, inline metrics, metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findoc.functions.cleaning import stripped

# Patterns and labels of filings. Digits are spelled out, so that Java, RE2 and Python read them alike.
SECTION = r"(?i)^(?:ITEM\s+[0-9A-Z]+[.\s\-:]+|NOTE\s+[0-9]+[.\s\-:]+|PART\s+[IVX]+[.\s\-:]+|MANAGEMENT'S DISCUSSION|CONSOLIDATED STATEMENTS|FINANCIAL STATEMENTS|BUSINESS OVERVIEW|RISK FACTORS|EXECUTIVE SUMMARY|OUTLOOK|HIGHLIGHTS)"
FIGURE = r"(?i)^(?:Figure|Chart)\s*[0-9]*:"
METRIC = r"(?i)^[A-Za-z\s]+:\s*\$?[0-9]+(?:\.[0-9]+)?%?\s*(?:million|billion|M|B)?$"
INLINE = r"(?i)\b([A-Za-z\s]{3,30}?)\s*(?:was|is|reached|of|amounted to|increased to|decreased to)?\s*(\$?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?\s*(?:billion|million|thousand|B|M|K|%)?)\b"
# A run of letters and blanks without a digit before it or a number after it is in no match: its first and last characters do.
NO_INLINE = r"(?<![A-Za-z\s0-9])([A-Za-z\s])[A-Za-z\s]++(?<=([A-Za-z\s]))(?!\$?[0-9])"
INLINE_TERMS = ("revenue", "sales", "income", "profit", "margin", "eps", "cash", "flow", "expense", "ebitda", "debt", "equity", "capex")
ITEMS = [
    (r"1\.\s+business", "Item 1: Business"),
    (r"1a\.\s+risk\s+factors", "Item 1A: Risk Factors"),
    (r"1b\.\s+unresolved\s+staff\s+comments", "Item 1B: Unresolved Staff Comments"),
    (r"2\.\s+properties", "Item 2: Properties"),
    (r"3\.\s+legal\s+proceedings", "Item 3: Legal Proceedings"),
    (r"7\.\s+management'?s\s+discussion\s+and\s+analysis", "Item 7: MD&A"),
    (r"7a\.\s+quantitative\s+and\s+qualitative\s+disclosures", "Item 7A: Market Risk Disclosures"),
    (r"8\.\s+financial\s+statements", "Item 8: Financial Statements and Supplementary Data"),
    (r"9\.\s+changes\s+in\s+and\s+disagreements", "Item 9: Accounting Disagreements"),
]
TICKER = r"(?i)(?:ticker|symbol|nasdaq|nyse)\s*[:=(\[]?\s*([A-Z]{1,5})\b"
FISCAL_YEAR = r"(?i)(?:fiscal\s+year\s+ended|year\s+ended|period\s+ended|for\s+the\s+year|fiscal\s+year|fy)\s*[A-Za-z0-9,\s]*?\b(20[0-9]{2})\b"
PERIOD = r"(?i)\b(Q[1-4]|FY|FY[0-9]{2,4}|Annual|Quarterly)\b"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, p): parts between blank lines, trimmed, empty ones left out."""
    split = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n\n")).alias("pos", "p"))
    # one pass, whatever runs of blanks the text holds
    return split.select("doc_id", "pos", F.btrim("p", F.lit(" \t\n\x0b\f\r")).alias("p")).where("p <> ''")


def modality(p: Column) -> Column:
    pipes = F.size(F.split(p, r"\|")) - 1
    table = (pipes > 0) & (F.contains(p, F.lit("---")) | (pipes >= 4))
    return F.when(table, "table").when(p.rlike(FIGURE) | F.contains(p, F.lit("[Figure")), "figure").when(p.rlike(METRIC), "metric").otherwise("text")


def chunk_documents(docs: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """(doc_id, text) to chunks: doc_id, chunk_id, seq, modal_type, content, section_title, token_count, start_idx, metrics.

    A section header holds for what follows it. Narrative of more than ``size`` words is cut into windows of that size
    that overlap; start_idx is the first word's number there, null elsewhere. ``metrics`` are the (name, raw) amounts of
    running text, in each window those that it holds, and of a line that is a metric; tables have theirs in their cells.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    head = stripped(F.element_at(F.split("p", "\n"), 1))
    # dealt before the work on texts: a table may come as a single file
    marked = paragraphs(docs.select("doc_id", "text").repartition("doc_id")).withColumns({"modal_type": modality(F.col("p")), "own": F.when(head.rlike(SECTION), F.regexp_replace(head, ":+$", ""))})
    marked = marked.withColumn("section_title", F.last("own", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # amounts are looked for once a paragraph, not once a window; nothing but the windows goes on from here
    marked = marked.withColumn("amounts", F.when(F.col("modal_type") == "text", inline_metrics(F.col("p"))))
    line = F.when(F.col("modal_type") == "metric", F.array(F.struct(stripped(F.regexp_extract("p", r"^([^:]*):", 1)).alias("name"), stripped(F.regexp_extract("p", r"(?s)^[^:]*:(.*)$", 1)).alias("raw"))))
    cut = marked.withColumn("line", line).select("doc_id", "pos", "modal_type", "section_title", "amounts", "line", F.inline(_windows(size, overlap)))
    own = F.filter("amounts", lambda m: F.contains(F.col("content"), m["raw"]))
    none = F.array().cast("array<struct<name:string,raw:string>>")
    cut = cut.withColumn("metrics", F.coalesce(own, "line", none)).drop("amounts", "line")
    cut = cut.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "start")) - 1)
    return cut.select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("seq").cast("string")).alias("chunk_id"), "seq", "modal_type", "content", "section_title",
        F.floor(F.col("count") * 1.3).alias("token_count"), "start_idx", "metrics",
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it, inside of lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(size: int, overlap: int) -> Column:
    """array<struct<start, count, content, start_idx>> of rows with the paragraph p and its modality."""
    whole = lambda w: F.array(F.struct(F.lit(0).alias("start"), F.size(w).alias("count"), F.col("p").alias("content"), F.lit(None).cast("int").alias("start_idx")))
    part = lambda w, at: F.struct(at.alias("start"), F.least(F.size(w) - at, F.lit(size)).alias("count"), F.array_join(F.slice(w, at + 1, F.lit(size)), " ").alias("content"), at.alias("start_idx"))
    parts = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(size - overlap)), lambda at: part(w, at))
    # a trimmed paragraph has no empty words
    return _let(F.split("p", r"\s+"), lambda w: F.when((F.col("modal_type") == "text") & (F.size(w) > size), parts(w)).otherwise(whole(w)))


def document_metrics(chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, name, raw): the metrics of all chunks and of all tables' cells, each once. ``tables``: (doc_id, table_id, table)."""
    from findoc.operators.tables import metrics

    of_chunks = chunks.select("doc_id", "chunk_id", F.explode("metrics").alias("m")).select("doc_id", F.col("chunk_id").cast("string").alias("chunk_id"), "m.name", "m.raw")
    of_tables = metrics(tables.select("table_id", "table")).join(tables.select("table_id", "doc_id"), "table_id")
    return of_chunks.unionByName(of_tables.select("doc_id", F.col("table_id").cast("string").alias("chunk_id"), "name", "raw"))


def _cut_sections(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, any (whether the text has filing items), pos, part (as the text has it), content and label."""
    names = "|".join(pattern for pattern, _ in ITEMS)
    text = F.coalesce("text", F.lit(""))
    parts = F.split(F.regexp_replace(text, rf"(?imd)^(\s*item\s+(?:{names})\b)", "\x01$1"), "\x01")
    cut = docs.select("*", (F.size(parts) > 1).alias("any"), F.posexplode(parts).alias("pos", "part")).withColumn("content", stripped(F.col("part")))
    label = F.lit("General Filing")
    for pattern, name in ITEMS:
        label = F.when(F.col("content").rlike(rf"(?i)^item\s+{pattern}\b"), name).otherwise(label)
    named = F.when(~F.col("any"), "General Filing").when(F.col("pos") == 0, "Filing Header & Preamble").otherwise(label)
    return cut.withColumn("label", named)


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, label, content): filing items in order, what stands before them, or the whole text as one."""
    cut = _cut_sections(docs.select("doc_id", "text")).where("content <> '' or not any")
    return cut.select("doc_id", "pos", "label", F.when(F.col("any"), F.col("content")).otherwise(F.col("part")).alias("content"))


def _placed(parts: DataFrame, gap: int) -> DataFrame:
    """``parts`` (row, pos, n, ...) with start_at and end_at, where the parts of a row follow one another ``gap`` characters apart."""
    order = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("end_at", F.sum(F.col("n") + gap).over(order) - gap)
    return placed.withColumn("start_at", F.col("end_at") - F.col("n"))


def section_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, label, start_at, end_at): where each of ``sections`` starts in the text, and where the next one does or the text ends."""
    rows = docs.select("doc_id", F.translate("text", "\x01", "\x02").alias("text"), F.monotonically_increasing_id().alias("row"))
    parts = _cut_sections(rows).select("row", "doc_id", "pos", "label", F.length("part").alias("n"), ((F.col("content") != "") | ~F.col("any")).alias("some"))
    return _placed(parts, 0).where("some").select("doc_id", "pos", "label", "start_at", "end_at")


def line_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line, start_at, end_at): each line and where it starts and ends in the text. A null text is empty: one empty line."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    lines = rows.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return _placed(lines.withColumn("n", F.length("line")), 1).select("doc_id", "pos", "line", "start_at", "end_at")


def pack_sections(docs: DataFrame, most: int = 500) -> DataFrame:
    """(doc_id, chunk_id, label, content, token_count): paragraphs of a section joined greedily up to ``most`` words.

    The fold runs inside one expression over a section's paragraphs, in order.
    """
    parts = F.filter(F.transform(F.split("content", "\n\n"), stripped), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(state: Column, p: Column) -> Column:
        count = F.size(words(p))
        full = (state["n"] + count > most) & (state["open"] != "")
        joined = F.when(state["open"] == "", p).otherwise(F.concat(state["open"], F.lit("\n\n"), p))
        return F.struct(F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"), F.when(full, p).otherwise(joined).alias("open"), F.when(full, count).otherwise(state["n"] + count).alias("n"))

    packed = F.aggregate(parts, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    rows = sections(docs).select("doc_id", "pos", "label", F.posexplode(packed).alias("k", "content"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "k"))
    return rows.withColumn("number", number).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.lpad(F.col("number").cast("string"), 4, "0")).alias("chunk_id"), "label", "content", F.size(words(F.col("content"))).alias("token_count"))


def inline_metrics(text: Column) -> Column:
    """array<struct<name, raw>> of amounts in running text whose label holds a financial term.

    The pattern goes over the text without what no match can touch, so its steps go with the numbers, not with the words.
    """
    found = _let(F.regexp_replace(text, NO_INLINE, "$1$2"), lambda t: F.arrays_zip(F.regexp_extract_all(t, F.lit(INLINE), F.lit(1)).alias("name"), F.regexp_extract_all(t, F.lit(INLINE), F.lit(2)).alias("raw")))
    found = F.transform(found, lambda m: F.struct(stripped(m["name"]).alias("name"), stripped(m["raw"]).alias("raw")))
    terms = F.array(*map(F.lit, INLINE_TERMS))
    named = F.filter(found, lambda m: _let(F.lower(m["name"]), lambda low: F.exists(terms, lambda t: F.contains(low, t))))
    return F.when(text.rlike("[0-9]"), named).otherwise(F.array().cast("array<struct<name:string,raw:string>>"))


def detect_metadata(text: Column) -> dict[str, Column]:
    """ticker, year, period and doc_type as the first 2,500 characters of a filing state them."""
    head = F.substring(text, 1, 2500)
    low = F.lower(head)
    first = lambda pattern: F.nullif(F.regexp_extract(head, pattern, 1), F.lit(""))
    year = F.coalesce(first(FISCAL_YEAR), first(r"\b(20[0-9]{2})\b"), first(r"\b(19[0-9]{2})\b")).cast("int")
    has = lambda x: F.contains(low, F.lit(x))
    kind = F.when(has("10-k"), "10-K").when(has("10-q"), "10-Q").when(has("8-k"), "8-K").when(has("earnings release") | has("press release"), "earnings_release").otherwise("filing")
    return {"ticker": F.upper(first(TICKER)), "year": year, "period": F.upper(first(PERIOD)), "doc_type": kind}
