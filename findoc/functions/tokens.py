"""Token expressions: everything stays in the JVM as arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lexical index's patterns. Digits are spelled out, so that Java, RE2 and Python read them alike.
PAREN_NEGATIVE = r"\(([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?(?:[MBKmbk%])?)\)"
TOKEN = r"\$?-?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?%?(?:[a-zA-Z])?|[a-zA-Z0-9_\-]+"
# The same without single letters, which the index leaves out.
INDEX_TOKEN = TOKEN.removesuffix("+") + "{2,}"
# The reranker's and the grounder's patterns.
PAIR_TOKEN = r"[a-zA-Z0-9_\$%]+"
TERM = r"[a-zA-Z0-9_\-]+"
NUMBER = r"\b[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?\b"
SIGNED_NUMBER = r"-?\b[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?\b"
CLAIM_WORD = r"\b[A-Za-z0-9_\.]+\b"
YEAR = r"\b(20[0-9]{2}|19[0-9]{2})\b"
PERIOD = r"(?i)\b(Q[1-4]|FY|FY[0-9]{2,4})\b"


def every(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches, an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def lexical_tokens(text: Column) -> Column:
    """Index terms with repeats: parenthesised negatives get a minus, single letters go, and numbers with $, % or commas
    are also indexed without them (after all other terms)."""
    low = F.transform(every(F.regexp_replace(text, PAREN_NEGATIVE, "-$1"), INDEX_TOKEN), lambda t: F.lower(t))

    def bare_forms(t: Column) -> Column:
        bare = F.when(t.startswith("$"), F.ltrim(t, F.lit("$"))).when(t.endswith("%"), F.rtrim(t, F.lit("%"))).otherwise(F.lit(""))
        plain = lambda x: F.when(F.contains(x, F.lit(",")), F.replace(x, F.lit(","), F.lit("")))
        return F.array_compact(F.array(plain(t), F.when(bare != "", bare), plain(bare)))

    return F.concat(low, F.flatten(F.transform(F.filter(low, lambda t: t.rlike("[$%,]")), bare_forms)))


def numbers(text: Column, pattern: str = NUMBER) -> Column:
    """Numbers with their commas removed, with repeats."""
    return F.transform(every(text, pattern), lambda n: F.replace(n, F.lit(","), F.lit("")))


def bigrams(tokens: Column) -> Column:
    """Distinct neighbours, joined by a character that no token holds."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n), lambda a, b: F.concat_ws("\x01", a, b)))
