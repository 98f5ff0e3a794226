"""Cleaning expressions, string to string. Patterns take only line feeds for line ends, in the JVM as in other engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dashes, header tags, entities (in this order), number shapes.
DASHES = "‐‑‒–—―−﹘﹣－"
HEADER_LINE = r"^<(?:TYPE|SEQUENCE|FILENAME|DESCRIPTION)[^>]*>.*$"
WRAPPER = r"</?(?:DOCUMENT|TEXT|SEC-HEADER)[^>]*>"
TAG = r"<[^>]+>"
ENTITIES = [("&nbsp;", " "), ("&#160;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&mdash;", "-"), ("&ndash;", "-"), ("&minus;", "-")]
AMOUNT = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
NEGATIVES = [(rf"\(\s*([$€£¥])\s*({AMOUNT})\s*\)", "-$1$2"), (rf"\(\s*({AMOUNT})\s*%\s*\)", "-$1%"), (rf"\(\s*({AMOUNT})\s*\)", "-$1")]
FOOTNOTES = [r"\[\w+\]$", r"\([a-zA-Z]\)$", r"[*†‡]+$"]
PAGE_LINE = r"^\s*(?:Page\s+)?[0-9]+\s+(?:of\s+[0-9]+\s+)?$"
CONTENTS_LINE = r"^\s*Table of Contents\s*$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_dashes(text: Column) -> Column:
    return F.translate(text, DASHES, "-" * len(DASHES))


def strip_tags(text: Column) -> Column:
    """Header lines, then wrappers, then entities, then any tag; a decoded tag goes too."""
    out = F.regexp_replace(F.regexp_replace(text, "(?imd)" + HEADER_LINE, ""), "(?i)" + WRAPPER, "")
    for name, value in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.regexp_replace(out, TAG, "")


def normalize_negatives(text: Column) -> Column:
    for pattern, value in NEGATIVES:
        text = F.regexp_replace(text, pattern, value)
    return text


def clean_cell(cell: Column) -> Column:
    """Trimmed, without one trailing footnote mark of each sort."""
    cell = stripped(cell)
    for pattern in FOOTNOTES:
        cell = stripped(F.regexp_replace(cell, pattern, ""))
    return cell


def clean_document(text: Column, strip_headers: bool = True) -> Column:
    """Tags, dashes, curly quotes, page and contents lines, negatives, trailing blanks; at most two blank lines in a row."""
    out = strip_tags(text) if strip_headers else text
    out = F.translate(normalize_dashes(out), "‘’“”", "''\"\"")
    out = F.regexp_replace(F.regexp_replace(out, "(?imd)" + PAGE_LINE, ""), "(?imd)" + CONTENTS_LINE, "")
    out = F.regexp_replace(F.replace(normalize_negatives(out), F.lit("\r\n"), F.lit("\n")), r"(?md)[ \t\r]+$", "")
    return F.coalesce(stripped(F.regexp_replace(out, "\n{4,}", "\n\n\n")), F.lit(""))


def repair_table(text: Column) -> Column:
    """A markdown table with rows padded to the widest, cells cleaned and its second line, if dashes, in standard form."""
    lines = F.filter(F.transform(F.split(stripped(text), "\n"), stripped), lambda x: x != "")
    core = lambda x: F.split(F.regexp_replace(F.regexp_replace(x, r"^\|", ""), r"\|$", ""), r"\|")
    width = F.array_max(F.transform(lines, lambda x: F.when(F.contains(x, F.lit("|")), F.size(core(x))).otherwise(0)))

    def row(line: Column, at: Column) -> Column:
        cells = F.transform(core(line), clean_cell)
        padded = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))
        dashes = (at == 1) & F.forall(padded, lambda c: c.rlike("^[-: ]*$"))
        shown = F.when(dashes, F.transform(padded, lambda c: F.when(c.startswith(":"), ":---").otherwise("---"))).otherwise(padded)
        return F.when(F.contains(line, F.lit("|")), F.concat(F.lit("| "), F.array_join(shown, " | "), F.lit(" |"))).otherwise(line)

    return F.when(F.coalesce(F.size(lines), F.lit(0)) == 0, "").when(width == 0, text).otherwise(F.array_join(F.transform(lines, row), "\n"))
