"""Figures described in texts: caption, chart type, scale, axes, data points and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findoc.functions.cleaning import stripped
from findoc.operators.tables import first_of

# Words and patterns, in order. Digits are spelled out, so that Java, RE2 and Python read them alike.
CHARTS = [("waterfall", ("waterfall", "bridge", "walk")), ("pie", ("pie", "donut", "doughnut")), ("bar", ("bar", "column", "histogram")), ("line", ("line", "trend", "trajectory")), ("scatter", ("scatter", "bubble")), ("area", ("area",))]
FIGURE_SCALES = [("billions", ("billion", "$b")), ("millions", ("million", "$m")), ("thousands", ("thousand", "$k")), ("percent", ("%", "percent"))]
FIGURE_UNITS = [("USD", ("$", "usd")), ("EUR", ("€", "eur")), ("GBP", ("£", "gbp")), ("JPY", ("¥", "jpy"))]
CAPTION = r"(?i)(?:Figure|Chart)\s*[0-9]*[:\-–]\s*([^\n]+)"
BRACKET_CAPTION = r"(?i)\[Figure[^:]*:\s*([^\]]+)\]"
X_AXIS = r"(?i)(?:x-axis|horizontal\s+axis|x)\s*[:=]\s*([^\n,;]+)"
Y_AXIS = r"(?i)(?:y-axis|vertical\s+axis|y)\s*[:=]\s*([^\n,;]+)"
POINT = r"^([A-Za-z0-9_\s\-/&]+)[:=]\s*\$?([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)\s*(?:M|B|K|%)?"
LOOSE_POINT = r"([A-Za-z0-9_\s]+):\s*\$?([0-9]+(?:\.[0-9]+)?)"
BLOCK = r"(?i)(\[Figure[^\]]+\]|\*\*Figure[^*]+\*\*|Figure\s+[0-9]*:[^\n]+(?:\n[ \t]+[^\n]+)*)"
STRUCTURAL = ("figure", "chart", "x-axis", "y-axis", "x", "y")


def _short(value: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")


def _last_wins(points: Column) -> Column:
    """Points of one name fold into the first place with the last value."""
    names = F.array_distinct(F.transform(points, lambda p: p["k"]))
    return F.transform(names, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(points, lambda p: p["k"] == k), -1)["v"].alias("v")))


def parse_figure(text: Column) -> dict[str, Column]:
    """caption, chart_type, summary_text, data_points (array<struct<k, v>>, in order), x_label, y_label, unit, scale."""
    low = F.lower(text)
    first = lambda pattern: F.nullif(stripped(F.regexp_extract(text, pattern, 1)), F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(stripped(x), "^[-*• ]+", ""))
    found = F.transform(F.filter(lines, lambda x: x.rlike(POINT)), lambda x: F.struct(stripped(F.regexp_extract(x, POINT, 1)).alias("k"), F.replace(F.regexp_extract(x, POINT, 2), F.lit(","), F.lit("")).cast("double").alias("v")))
    found = _last_wins(F.filter(found, lambda p: ~F.lower(p["k"]).isin(*STRUCTURAL, "source", "note")))
    loose = F.zip_with(F.regexp_extract_all(text, F.lit(LOOSE_POINT), F.lit(1)), F.regexp_extract_all(text, F.lit(LOOSE_POINT), F.lit(2)), lambda k, v: F.struct(stripped(k).alias("k"), v.cast("double").alias("v")))
    loose = _last_wins(F.filter(loose, lambda p: ~F.lower(p["k"]).isin(*STRUCTURAL)))
    points = F.when(F.size(found) > 0, found).otherwise(loose)
    stated = F.coalesce(first(CAPTION), F.when(F.contains(text, F.lit("[Figure")), first(BRACKET_CAPTION)))
    chart = first_of(low, CHARTS, "chart")
    shown = F.array_join(F.transform(F.slice(points, 1, 5), lambda p: F.concat(p["k"], F.lit(": "), _short(p["v"]))), ", ")
    made = F.concat(F.coalesce(stated, F.lit("Figure")), F.lit(" showing "), chart, F.lit(" distribution: "), shown)
    return {
        "caption": F.coalesce(stated, F.element_at(F.split(text, "\n"), 1)),
        "chart_type": chart,
        "summary_text": F.when((F.size(points) > 0) & (stated.isNull() | (F.length(stripped(text)) < 50)), made).otherwise(stripped(text)),
        "data_points": points,
        "x_label": first(X_AXIS),
        "y_label": first(Y_AXIS),
        "unit": first_of(low, FIGURE_UNITS, "USD"),
        "scale": first_of(low, FIGURE_SCALES, "millions"),
    }


def extract_figures(docs: DataFrame) -> DataFrame:
    """(doc_id, figure_id, block) of the figure notes in (doc_id, text)."""
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(BLOCK), F.lit(1))).alias("n", "block"))
    return found.select("doc_id", F.concat(F.lit("fig_"), (F.col("n") + 1).cast("string")).alias("figure_id"), "block")


def point_statistics(points: Column) -> dict[str, Column]:
    """total, and the greatest and least point; the first of equal ones."""
    by = lambda better: F.aggregate(points, F.lit(None).cast("struct<k:string,v:double>"), lambda s, p: F.when(s.isNull() | better(p["v"], s["v"]), p).otherwise(s))
    return {
        "total": F.aggregate(points, F.lit(0.0), lambda s, p: s + p["v"]),
        "max_point": by(lambda a, b: a > b)["k"],
        "min_point": by(lambda a, b: a < b)["k"],
    }


def to_markdown(caption: Column, summary: Column, points: Column, unit: Column) -> Column:
    lines = F.transform(points, lambda p: F.concat(F.lit("- "), p["k"], F.lit(": "), _short(p["v"]), F.when(unit.isNotNull(), F.concat(F.lit(" "), unit)).otherwise("")))
    return F.concat_ws("\n", F.when(caption.isNotNull(), F.concat(F.lit("**Figure: "), caption, F.lit("**"))), summary, F.when(F.size(points) > 0, F.array_join(lines, "\n")))
