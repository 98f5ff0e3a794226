"""What filings, chunks, citations and answers say about themselves, as expressions: headers, index texts, badges, summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _given(c: Column) -> Column:
    """Null where a string is null or empty."""
    return F.nullif(c.cast("string"), F.lit(""))


def header_summary(ticker: Column, period: Column, year: Column, doc_type: Column) -> Column:
    """[ticker | period year | type] of what is known."""
    return F.concat(F.lit("["), F.concat_ws(" | ", _given(ticker), _given(F.concat_ws(" ", _given(period), year.cast("string"))), _given(doc_type)), F.lit("]"))


def inline_badge(doc_id: Column, page: Column, chunk_id: Column) -> Column:
    """[doc:pN#chunk]"""
    return F.format_string("[%s:p%d#%s]", doc_id.cast("string"), page.cast("int"), chunk_id.cast("string"))


def short_number(v: Column) -> Column:
    """Six significant digits without trailing zeros; very large and small ones with an exponent."""
    size = F.abs(v)
    power = F.when(size > 0, F.floor(F.log10(size))).otherwise(F.lit(0))
    unit = F.pow(F.lit(10.0), F.lit(5) - power)
    kept = F.round(v * unit)  # up to six digits
    power = power + F.when(F.abs(kept) >= 1e6, 1).otherwise(0)
    plain = lambda x: F.regexp_replace(F.regexp_replace(x.cast("decimal(38,10)").cast("string"), "0+$", ""), r"\.$", "")
    mantissa = plain(F.round(v / F.pow(F.lit(10.0), power), 5))
    exponent = F.format_string("e%s%02d", F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("int"))
    return F.when(v == 0, "0").when((power < -4) | (power >= 6), F.concat(mantissa, exponent)).otherwise(plain(kept / unit))


def enriched_text(content: Column, section: Column, modal: Column, title: Column | None = None, statement: Column | None = None, scale: Column | None = None, footnotes: Column | None = None, caption: Column | None = None, chart: Column | None = None, points: Column | None = None, metrics: Column | None = None) -> Column:
    """What an index is made of: a chunk's content with its section, and what is known of its table, figure and metrics.

    ``footnotes``: array of strings; ``points``: array of struct(k, v); ``metrics``: array of struct(name, shown).
    """
    table, figure = modal == "table", modal == "figure"
    none = F.lit(None).cast("string")
    named = lambda prefix, c, when: F.when(when & _given(c).isNotNull(), F.concat(F.lit(prefix), c.cast("string"))) if c is not None else none
    listed = lambda prefix, items, sep, end, when: F.when(when & (F.size(items) > 0), F.concat(F.lit(prefix), F.array_join(items, sep), F.lit(end)))
    parts = [
        F.when(_given(section).isNotNull(), F.concat(F.lit("[Section: "), section, F.lit("]"))),
        named("Table: ", title, table), named("Statement: ", None if statement is None else F.when(statement != "unknown", statement), table), named("Scale: ", scale, table),
        named("Figure: ", caption, figure), named("Chart Type: ", chart, figure),
        none if points is None else listed("Data: ", F.transform(points, lambda p: F.concat_ws("=", p["k"], short_number(p["v"]))), ", ", "", figure),
        F.coalesce(content, F.lit("")),
        none if footnotes is None else listed("Footnotes: ", footnotes, " ", "", table),
        none if metrics is None else listed("[Metrics: ", F.transform(metrics, lambda m: F.concat_ws(": ", m["name"], m["shown"])), "; ", "]", F.lit(True)),
    ]
    return F.concat_ws("\n", *parts)


def coerced(ticker: Column, period: Column, page_count: Column, year: Column) -> dict[str, Column]:
    """ticker and period trimmed and in upper case, at least one page, and the error of a year outside 1900 to 2100."""
    outside = year.isNotNull() & ((year < 1900) | (year > 2100))
    return {
        "ticker": F.upper(F.trim(ticker)), "period": F.upper(F.trim(period)), "page_count": F.greatest(F.lit(1), F.coalesce(page_count, F.lit(1))).cast("int"),
        "year": F.when(~outside, year), "error": F.when(outside, F.format_string("year %d is outside 1900 to 2100", year)),
    }


def fully_grounded(total: Column, supported: Column) -> Column:
    """Whether there are claims and all of them are supported."""
    return (F.coalesce(total, F.lit(0)) > 0) & (total == supported)


def response_summary(query: Column, chunks: Column, citations: Column, supported: Column, claims: Column, confidence: Column, latency_ms: Column, cache_type: Column) -> Column:
    """One line about an answer; ``cache_type`` is null where no cache answered."""
    cached = F.coalesce(F.concat(F.lit(" | Cache: "), cache_type), F.lit(""))
    return F.concat(F.format_string("Query: '%s' | Chunks: %d | Citations: %d | Grounded: %d/%d | Conf: %.2f | Latency: %.1fms", query, chunks, citations, supported, claims, confidence, latency_ms), cached)
