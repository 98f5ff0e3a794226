"""Queries over texts: cleaning, amounts, chunks, sections, figures, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from findoc.functions import cleaning, finance
from findoc.functions.tokens import NUMBER, numbers
from findoc.operators import figures, parse
from findoc.operators import tables as tb
from findoc.plans import fixtures as fx
from findoc.plans.base import query, table

_STRIP = r"^\s+|\s+$"


def _tags_sql(x: str) -> str:
    x = rf"regexp_replace(regexp_replace({x}, '(?im)^<(?:TYPE|SEQUENCE|FILENAME|DESCRIPTION)[^>]*>.*$', '', 'g'), '(?i)</?(?:DOCUMENT|TEXT|SEC-HEADER)[^>]*>', '', 'g')"
    for name, value in cleaning.ENTITIES:
        x = f"replace({x}, '{name}', '{value.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace({x}, '<[^>]+>', '', 'g')"


def _negatives_sql(x: str) -> str:
    amount = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
    x = rf"regexp_replace({x}, '\(\s*([$€£¥])\s*({amount})\s*\)', '-\1\2', 'g')"
    x = rf"regexp_replace({x}, '\(\s*({amount})\s*%\s*\)', '-\1%', 'g')"
    return rf"regexp_replace({x}, '\(\s*({amount})\s*\)', '-\1', 'g')"


def _clean_sql(x: str) -> str:
    x = f"translate(translate({_tags_sql(x)}, '{cleaning.DASHES}', '----------'), '‘’“”', '''''\"\"')"
    x = rf"regexp_replace(regexp_replace({x}, '(?im)^\s*(?:Page\s+)?[0-9]+\s+(?:of\s+[0-9]+\s+)?$', '', 'g'), '(?im)^\s*Table of Contents\s*$', '', 'g')"
    x = rf"regexp_replace(replace({_negatives_sql(x)}, chr(13) || chr(10), chr(10)), '(?m)[ \t\r]+$', '', 'g')"
    return rf"regexp_replace(regexp_replace({x}, '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '{_STRIP}', '', 'g')"


@query("clean_html_pages", f"SELECT page_id, {_clean_sql('html')} AS cleaned FROM pages")
def clean_html_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", cleaning.clean_document(F.col("html")).alias("cleaned"))


@query("clean_documents", f"SELECT doc_id, {_clean_sql('text')} AS cleaned FROM documents")
def clean_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.clean_document(F.col("text")).alias("cleaned"))


@query("clean_messy", f"SELECT id, {_clean_sql('text')} AS cleaned, {_negatives_sql('text')} AS negatives, translate(text, '{cleaning.DASHES}', '----------') AS dashes, {_tags_sql('text')} AS untagged FROM {fx.values_sql(fx.MESSY, 'id', 'text')}")
def clean_messy(spark, sf_dir):
    text = F.col("text")
    return fx.frame(spark, fx.MESSY, "id int, text string").select("id", cleaning.clean_document(text).alias("cleaned"), cleaning.normalize_negatives(text).alias("negatives"), cleaning.normalize_dashes(text).alias("dashes"), cleaning.strip_tags(text).alias("untagged"))


def _cell_sql(x: str) -> str:
    x = f"regexp_replace({x}, '{_STRIP}', '', 'g')"
    for pattern in (r"\[\w+\]$", r"\([a-zA-Z]\)$", r"[*†‡]+$"):
        x = f"regexp_replace(regexp_replace({x}, '{pattern}', ''), '{_STRIP}', '', 'g')"
    return x


@query("strip_footnotes", f"SELECT id, {_cell_sql('cell')} AS cell FROM {fx.values_sql(fx.CELLS, 'id', 'cell')}")
def strip_footnotes(spark, sf_dir):
    return fx.frame(spark, fx.CELLS, "id int, cell string").select("id", cleaning.clean_cell(F.col("cell")).alias("cell"))


@query("repair_tables", f"SELECT * FROM {fx.values_sql([(1, '| A | B | C |' + chr(10) + '| --- | --- |  |' + chr(10) + '| 1 | 2 |  |' + chr(10) + '| x | y | 3 |'), (2, 'no table'), (3, '| A |' + chr(10) + '| :--- |' + chr(10) + '| 1 |' + chr(10) + 'note below'), (4, '')], 'id', 'repaired')}".replace("| --- | --- |  |", "| --- | --- | --- |"))
def repair_tables(spark, sf_dir):
    return fx.frame(spark, fx.RAGGED, "id int, text string").select("id", cleaning.repair_table(F.col("text")).alias("repaired"))


# -- amounts --------------------------------------------------------------------------------------------------------

_SCALES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in finance.SCALES.items())


def _amount_sql(source: str, keys: str) -> str:
    return rf"""
a AS (SELECT {keys}, raw, regexp_replace(raw, '{_STRIP}', '', 'g') AS s FROM {source}),
b AS (SELECT *, regexp_full_match(s, '\(.*\)') AS wrapped, CASE WHEN regexp_full_match(s, '\(.*\)') THEN trim(s[2:-2]) WHEN starts_with(s, '-') THEN trim(ltrim(s, '-')) ELSE s END AS core,
  CASE WHEN contains(s, '$') THEN 'USD' WHEN contains(s, '€') THEN 'EUR' WHEN contains(s, '£') THEN 'GBP' WHEN contains(s, '¥') THEN 'JPY' ELSE 'USD' END AS unit FROM a),
c AS (SELECT *, lower(core) AS low, try_cast(nullif(regexp_replace(core, '[^0-9.]', '', 'g'), '') AS DOUBLE) * CASE WHEN wrapped OR starts_with(s, '-') THEN -1 ELSE 1 END AS value FROM b),
d AS (SELECT *, CASE WHEN contains(low, '%') THEN 'percent' WHEN ends_with(low, 't') OR contains(low, 'trillion') THEN 'trillions' WHEN ends_with(low, 'b') OR contains(low, 'billion') THEN 'billions'
  WHEN ends_with(low, 'm') OR contains(low, 'million') THEN 'millions' WHEN ends_with(low, 'k') OR contains(low, 'thousand') THEN 'thousands' ELSE 'ones' END AS scale FROM c),
amounts AS (SELECT *, round(value * CASE scale {_SCALES} END, 6) AS normalized FROM d)"""


@query("parse_metric_strings", f"WITH {_amount_sql(fx.values_sql(fx.RAW_AMOUNTS, 'raw'), '1 AS one')} SELECT raw, value, unit, scale, normalized FROM amounts")
def parse_metric_strings(spark, sf_dir):
    raw = fx.frame(spark, fx.RAW_AMOUNTS, "raw string")
    return raw.select("raw", finance.parse_amount(F.col("raw")).alias("a")).select("raw", "a.value", "a.unit", "a.scale", "a.normalized")


_LINE_RAW = "CASE l_linenumber % 6 WHEN 0 THEN concat('$', x, 'M') WHEN 1 THEN concat('(', x, ')') WHEN 2 THEN concat('-$', x, 'B') WHEN 3 THEN concat(x, '%') WHEN 4 THEN concat('€', x, 'K') ELSE concat(x, ' units') END"
_LINES = f"(SELECT l_orderkey, l_linenumber, {_LINE_RAW} AS raw FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS {{string}}) AS x FROM lineitem))"


@query("parse_line_amounts", f"WITH {_amount_sql(_LINES.format(string='VARCHAR'), 'l_orderkey, l_linenumber')} SELECT l_orderkey, l_linenumber, value, unit, scale, normalized FROM amounts")
def parse_line_amounts(spark, sf_dir):
    lines = spark.sql(f"SELECT * FROM {_LINES.format(string='STRING')}".replace("FROM lineitem", "FROM {lines}"), lines=table(spark, sf_dir, "lineitem"))
    return lines.select("l_orderkey", "l_linenumber", finance.parse_amount(F.col("raw")).alias("a")).select("l_orderkey", "l_linenumber", "a.value", "a.unit", "a.scale", "a.normalized")


@query("scale_multipliers", f"SELECT word, CASE lower(trim(word)) {_SCALES} ELSE 1.0 END::DOUBLE AS multiplier FROM {fx.values_sql(fx.SCALE_WORDS, 'word')}")
def scale_multipliers(spark, sf_dir):
    finance.register(spark)
    return fx.frame(spark, fx.SCALE_WORDS, "word string").select("word", F.expr("scale_multiplier(word)").alias("multiplier"))


@query(
    "format_metrics",
    f"""WITH {_amount_sql(_LINES.format(string='VARCHAR'), 'l_orderkey, l_linenumber')} SELECT l_orderkey, l_linenumber,
  CASE scale WHEN 'percent' THEN s || printf('%.1f', abs(value)) || '%' WHEN 'billions' THEN s || d || printf('%.2f', abs(value)) || 'B' || u WHEN 'millions' THEN s || d || printf('%.1f', abs(value)) || 'M' || u
    WHEN 'thousands' THEN s || d || format('{{:,}}', abs(value)::BIGINT) || 'K' || u ELSE s || d || format('{{:,}}', abs(value)::BIGINT) || '.00' || u END AS shown
FROM (SELECT *, CASE WHEN value < 0 THEN '-' ELSE '' END AS s, CASE WHEN unit = 'USD' THEN '$' ELSE '' END AS d, CASE WHEN unit <> 'USD' THEN ' ' || unit ELSE '' END AS u FROM (SELECT l_orderkey, l_linenumber, raw, value, unit, scale FROM amounts))""",
)
def format_metrics(spark, sf_dir):
    lines = spark.sql(f"SELECT * FROM {_LINES.format(string='STRING')}".replace("FROM lineitem", "FROM {lines}"), lines=table(spark, sf_dir, "lineitem"))
    lines = lines.withColumn("amount", finance.parse_amount(F.col("raw")))
    return lines.select("l_orderkey", "l_linenumber", finance.formatted(F.col("raw"), F.col("amount")).alias("shown"))


# -- counts ---------------------------------------------------------------------------------------------------------


@query("chunk_numbers", r"SELECT doc_id, list_sum(v) AS total, len(v) AS n FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '\b[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?\b'), lambda x: replace(x, ',', '')::DOUBLE) AS v FROM documents WHERE regexp_matches(text, '[0-9]')) WHERE len(v) > 0")
def chunk_numbers(spark, sf_dir):
    """Numbers of the texts that hold digits."""
    v = F.transform(numbers(F.col("text"), NUMBER), lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]")).select("doc_id", v.alias("v")).where(F.size("v") > 0)
    return rows.select("doc_id", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"), F.size("v").cast("long").alias("n"))


@query("word_counts", r"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS words, length(coalesce(text, '')) AS characters FROM documents")
def word_counts(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parse.words(text)).cast("long").alias("words"), F.length(text).cast("long").alias("characters"))


# -- chunks ---------------------------------------------------------------------------------------------------------

_SECTION = parse.SECTION.replace("'", "''")


def _chunks_sql(source: str) -> str:
    return rf"""
p AS (SELECT doc_id, pos - 1 AS pos, regexp_replace(p, '{_STRIP}', '', 'g') AS p FROM (SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10) || chr(10)) AS parts FROM {source}))),
q AS (SELECT *, length(p) - length(replace(p, '|', '')) AS pipes, regexp_replace(string_split(p, chr(10))[1], '{_STRIP}', '', 'g') AS head, list_filter(regexp_split_to_array(p, '\s+'), lambda w: w <> '') AS w FROM p WHERE p <> ''),
r AS (SELECT *, CASE WHEN pipes > 0 AND (contains(p, '---') OR pipes >= 4) THEN 'table' WHEN regexp_matches(p, '{parse.FIGURE}') OR contains(p, '[Figure') THEN 'figure' WHEN regexp_matches(p, '{parse.METRIC}') THEN 'metric' ELSE 'text' END AS modal_type,
  last_value(CASE WHEN regexp_matches(head, '{_SECTION}') THEN regexp_replace(head, ':+$', '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section_title FROM q),
s AS (SELECT *, unnest(CASE WHEN modal_type = 'text' AND len(w) > 500 THEN range(0, len(w), 400) ELSE [0] END) AS start, modal_type = 'text' AND len(w) > 500 AS long FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, start) - 1 AS seq FROM s)
SELECT doc_id, doc_id || '_chunk_' || seq AS chunk_id, modal_type, CASE WHEN long THEN array_to_string(w[start + 1:start + 500], ' ') ELSE p END AS content, section_title,
  floor((CASE WHEN long THEN least(len(w) - start, 500) ELSE len(w) END) * 1.3::DOUBLE)::BIGINT AS token_count, CASE WHEN long THEN start END::INTEGER AS start_idx FROM t"""


_CHUNK = ("doc_id", "chunk_id", "modal_type", "content", "section_title", "token_count", "start_idx")


@query("filing_chunks", f"WITH {_chunks_sql(fx.values_sql(fx.FILINGS, 'doc_id', 'text'))}")
def filing_chunks(spark, sf_dir):
    return parse.chunk_documents(fx.frame(spark, fx.FILINGS, "doc_id int, text string")).select(*_CHUNK)


@query("paragraph_chunks", f"WITH {_chunks_sql('(SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)')}")
def paragraph_chunks(spark, sf_dir):
    """Documents with every line a paragraph of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return parse.chunk_documents(docs).select(*_CHUNK)


@query("sliding_word_chunks", f"WITH {_chunks_sql('documents')}")
def sliding_word_chunks(spark, sf_dir):
    """Whole documents, in windows of 500 words that overlap by 100."""
    return parse.chunk_documents(table(spark, sf_dir, "documents")).select(*_CHUNK)


def _chunk_metrics_sql(source: str) -> str:
    return _chunks_sql(source).rsplit("SELECT doc_id, doc_id ||", 1)[0].rstrip() + rf""",
c AS (SELECT doc_id || '_chunk_' || seq AS chunk_id, doc_id, p, modal_type, CASE WHEN long THEN array_to_string(w[start + 1:start + 500], ' ') ELSE p END AS content FROM t),
f AS (SELECT chunk_id, doc_id, content, unnest(list_zip(regexp_extract_all(p, '{parse.INLINE}', 1), regexp_extract_all(p, '{parse.INLINE}', 2))) AS z FROM c WHERE modal_type = 'text'),
g AS (SELECT chunk_id, doc_id, content, regexp_replace(z[1], '{_STRIP}', '', 'g') AS name, regexp_replace(z[2], '{_STRIP}', '', 'g') AS raw FROM f)
SELECT doc_id, chunk_id, name, raw FROM g WHERE regexp_matches(lower(name), '{"|".join(parse.INLINE_TERMS)}') AND contains(content, raw)
UNION ALL SELECT doc_id, chunk_id, regexp_replace(string_split(p, ':')[1], '{_STRIP}', '', 'g'), regexp_replace(substr(p, strpos(p, ':') + 1), '{_STRIP}', '', 'g') FROM c WHERE modal_type = 'metric'"""


#: Every document, and again with amounts in its text and a line that is one.
_WITH_AMOUNTS = "SELECT doc_id, text FROM {docs} UNION ALL SELECT -doc_id, concat('Total revenue was $1,250 million and the margin reached 41.6%. ', text, '. Net income of 45 million.', chr(10), chr(10), 'Cash: $', CAST(doc_id AS STRING)) AS text FROM {docs} WHERE text IS NOT NULL AND doc_id > 0"


@query("chunk_metrics", f"WITH {_chunk_metrics_sql('(' + _WITH_AMOUNTS.format(docs='documents').replace('STRING', 'VARCHAR') + ')')}")
def chunk_metrics(spark, sf_dir):
    """Amounts in the running text of all documents, window by window, and in metric lines."""
    docs = spark.sql(_WITH_AMOUNTS, docs=table(spark, sf_dir, "documents"))
    none = fx.frame(spark, [], "doc_id bigint, text string")
    no_tables = tb.extract_tables(none).withColumn("table_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("number").cast("string")))
    return parse.document_metrics(parse.chunk_documents(docs), no_tables)


_ITEM = "|".join(p for p, _ in parse.ITEMS).replace("'", "''")
_LABELS = " ".join(rf"WHEN regexp_matches(c, '(?i)^item\s+{p.replace(chr(39), chr(39) * 2)}\b') THEN '{name}'" for p, name in parse.ITEMS)


def _sections_sql(source: str) -> str:
    return rf"""
m AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '(?im)^(\s*item\s+(?:{_ITEM})\b)', chr(1) || '\1', 'g'), chr(1)) AS parts FROM {source}),
n AS (SELECT doc_id, len(parts) > 1 AS found_any, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM m),
o AS (SELECT *, regexp_replace(part, '{_STRIP}', '', 'g') AS c FROM n),
sec AS (SELECT doc_id, pos::INTEGER AS pos, CASE WHEN NOT found_any THEN 'General Filing' WHEN pos = 0 THEN 'Filing Header & Preamble' {_LABELS} ELSE 'General Filing' END AS label, CASE WHEN found_any THEN c ELSE part END AS content FROM o WHERE c <> '' OR NOT found_any)"""


@query("section_split", f"WITH {_sections_sql(fx.values_sql(fx.FILINGS, 'doc_id', 'text'))} SELECT * FROM sec")
def section_split(spark, sf_dir):
    return parse.sections(fx.frame(spark, fx.FILINGS, "doc_id int, text string"))


@query(
    "document_line_offsets",
    """WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS pos FROM d),
e AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY r ORDER BY pos) - 1 AS end_at FROM l)
SELECT doc_id, pos::INTEGER AS pos, line, (end_at - length(line))::BIGINT AS start_at, end_at::BIGINT AS end_at FROM e""",
)
def document_line_offsets(spark, sf_dir):
    """Every line of every document, with its start and end."""
    return parse.line_spans(table(spark, sf_dir, "documents"))


_TITLED = "SELECT doc_id, concat('About the firm', chr(10), 'Item 1. Business', chr(10), text, chr(10), chr(10), '  ITEM 7. MANAGEMENT''S DISCUSSION AND ANALYSIS', chr(10), left(text, 100)) AS text FROM {docs} UNION ALL SELECT -doc_id, text FROM {docs}"


@query(
    "document_section_offsets",
    rf"""WITH t AS (SELECT row_number() OVER () AS doc_id, doc_id AS id, text FROM ({_TITLED.format(docs="documents")})), {_sections_sql("t")},
e AS (SELECT doc_id, pos, length(part) AS n, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY pos) AS end_at FROM o)
SELECT t.id AS doc_id, sec.pos, label, (end_at - n)::BIGINT AS start_at, end_at::BIGINT AS end_at FROM sec JOIN e ON e.doc_id = sec.doc_id AND e.pos = sec.pos JOIN t ON t.doc_id = sec.doc_id""",
)
def document_section_offsets(spark, sf_dir):
    """Sections of every document, as it is (negative id) and as the body of two filing items, with their starts and ends."""
    return parse.section_spans(spark.sql(_TITLED, docs=table(spark, sf_dir, "documents")))


@query(
    "greedy_pack_chunks",
    rf"""WITH RECURSIVE {_sections_sql("(SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)")},
pp AS (SELECT doc_id, label, generate_subscripts(ps, 1) AS k, unnest(ps) AS p FROM (SELECT doc_id, label, list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda x: regexp_replace(x, '{_STRIP}', '', 'g')), lambda x: x <> '') AS ps FROM sec)),
pw AS (SELECT *, len(list_filter(regexp_split_to_array(p, '\s+'), lambda w: w <> '')) AS n FROM pp),
fold AS (
  SELECT doc_id, k, p, n AS words, 1 AS grp FROM pw WHERE k = 1
  UNION ALL
  SELECT w.doc_id, w.k, w.p, CASE WHEN f.words + w.n > 500 THEN w.n ELSE f.words + w.n END, CASE WHEN f.words + w.n > 500 THEN f.grp + 1 ELSE f.grp END FROM fold f JOIN pw w ON w.doc_id = f.doc_id AND w.k = f.k + 1
)
SELECT doc_id, doc_id || '_chunk_' || lpad(grp::VARCHAR, 4, '0') AS chunk_id, 'General Filing' AS label, string_agg(p, chr(10) || chr(10) ORDER BY k) AS content, max(words)::INTEGER AS token_count FROM fold GROUP BY doc_id, grp""",
)
def greedy_pack_chunks(spark, sf_dir):
    """Lines of documents packed up to 500 words; none of them holds a filing item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return parse.pack_sections(docs)


@query("filing_sections_packed")
def filing_sections_packed(spark, sf_dir):
    return parse.pack_sections(fx.frame(spark, fx.FILINGS, "doc_id int, text string"), 12)


@query(
    "inline_metrics",
    rf"""WITH f AS (SELECT doc_id, unnest(list_zip(regexp_extract_all(text, '{parse.INLINE}', 1), regexp_extract_all(text, '{parse.INLINE}', 2))) AS z FROM {fx.values_sql(fx.FILINGS, 'doc_id', 'text')})
SELECT doc_id, regexp_replace(z[1], '{_STRIP}', '', 'g') AS name, regexp_replace(z[2], '{_STRIP}', '', 'g') AS raw FROM f WHERE regexp_matches(lower(z[1]), '{"|".join(parse.INLINE_TERMS)}')""",
)
def inline_metrics(spark, sf_dir):
    found = fx.frame(spark, fx.FILINGS, "doc_id int, text string").select("doc_id", F.explode(parse.inline_metrics(F.col("text"))).alias("m"))
    return found.select("doc_id", "m.name", "m.raw")


def _metadata_sql(source: str) -> str:
    x = "left(text, 2500)"
    return rf"""SELECT doc_id, upper(nullif(regexp_extract({x}, '{parse.TICKER}', 1), '')) AS ticker,
  coalesce(nullif(regexp_extract({x}, '{parse.FISCAL_YEAR}', 1), ''), nullif(regexp_extract({x}, '\b(20[0-9]{{2}})\b', 1), ''), nullif(regexp_extract({x}, '\b(19[0-9]{{2}})\b', 1), ''))::INTEGER AS year,
  upper(nullif(regexp_extract({x}, '{parse.PERIOD}', 1), '')) AS period,
  CASE WHEN contains(lower({x}), '10-k') THEN '10-K' WHEN contains(lower({x}), '10-q') THEN '10-Q' WHEN contains(lower({x}), '8-k') THEN '8-K' WHEN contains(lower({x}), 'earnings release') OR contains(lower({x}), 'press release') THEN 'earnings_release' ELSE 'filing' END AS doc_type FROM {source}"""


@query("detect_metadata", _metadata_sql(fx.values_sql(fx.FILINGS, "doc_id", "text")))
def detect_metadata(spark, sf_dir):
    found = parse.detect_metadata(F.col("text"))
    return fx.frame(spark, fx.FILINGS, "doc_id int, text string").select("doc_id", *[c.alias(name) for name, c in found.items()])


@query(
    "figure_parse",
    f"""SELECT * FROM {fx.values_sql([(1, 'Revenue mix by segment in millions', 'chart', 'millions', 'USD', 'Segment', 'USD', 1794.7, 'Hardware', 'Services'), (2, 'quarterly trend', 'line', 'millions', 'USD', None, None, 23.0, 'Q2', 'Q1'), (3, 'Cash bridge] opening: 5 closing: 9', 'waterfall', 'millions', 'USD', None, None, 14.0, 'closing', 'opening'), (4, 'A pie without numbers', 'pie', 'millions', 'USD', None, None, 0.0, None, None)], 'id', 'caption', 'chart_type', 'scale', 'unit', 'x_label', 'y_label', 'total', 'max_point', 'min_point')}""".replace("SELECT * FROM (SELECT *", "SELECT id, caption, chart_type, scale, unit, x_label, y_label, total::DOUBLE AS total, max_point, min_point FROM (SELECT *"),
)
def figure_parse(spark, sf_dir):
    rows = fx.frame(spark, fx.FIGURES, "id int, text string")
    parsed = figures.parse_figure(F.col("text"))
    found = rows.select("id", *[c.alias(name) for name, c in parsed.items()])
    stats = figures.point_statistics(F.col("data_points"))
    return found.select("id", "caption", "chart_type", "scale", "unit", "x_label", "y_label", F.round(stats["total"], 6).alias("total"), stats["max_point"].alias("max_point"), stats["min_point"].alias("min_point"))


@query("figure_blocks", rf"WITH f AS (SELECT doc_id, regexp_extract_all(text, '{figures.BLOCK}', 1) AS b FROM {fx.values_sql(fx.FILINGS + [(r[0] + 10, r[1]) for r in fx.FIGURES], 'doc_id', 'text')}) SELECT doc_id, 'fig_' || generate_subscripts(b, 1) AS figure_id, unnest(b) AS block FROM f")
def figure_blocks(spark, sf_dir):
    return figures.extract_figures(fx.frame(spark, fx.FILINGS + [(r[0] + 10, r[1]) for r in fx.FIGURES], "doc_id int, text string"))
