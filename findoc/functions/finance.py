"""Amounts, scales and variances as expressions; ``register`` makes them SQL functions that the optimiser inlines."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from findoc.functions.cleaning import stripped

#: What a scale word multiplies by.
SCALES = {
    "ones": 1.0, "units": 1.0, "one": 1.0, "thousands": 1e3, "thousand": 1e3, "k": 1e3, "millions": 1e6, "million": 1e6, "m": 1e6,
    "billions": 1e9, "billion": 1e9, "b": 1e9, "trillions": 1e12, "trillion": 1e12, "t": 1e12, "percent": 0.01, "percentage": 0.01,
    "%": 0.01, "ratio": 1.0, "bps": 0.0001, "basis_points": 0.0001,
}


def scale_multiplier(scale: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(scale))), F.lit(1.0))


def parse_amount(raw: Column, unit: Column | None = None, scale: Column | None = None) -> Column:
    """struct(value, unit, scale, normalized) of a raw amount such as $1,250M, (45.2) or 12%.

    Only parentheses around the whole string or a leading minus make it negative; a currency sign sets the unit, and a
    percent sign, a last letter or a word the scale. Digits and points are what is left; null if they are no number.
    """
    text = stripped(raw)
    sign = F.when(F.contains(text, F.lit("$")), "USD").when(F.contains(text, F.lit("€")), "EUR").when(F.contains(text, F.lit("£")), "GBP").when(F.contains(text, F.lit("¥")), "JPY")
    wrapped = text.rlike(r"^\(.*\)$")
    negative = wrapped | text.startswith("-")
    core = F.when(wrapped, stripped(F.regexp_extract(text, r"^\((.*?)\)$", 1))).when(text.startswith("-"), stripped(F.regexp_replace(text, "^-+", ""))).otherwise(text)
    low = F.lower(core)
    ends = lambda letter, word: low.endswith(letter) | F.contains(low, F.lit(word))
    found = F.when(F.contains(low, F.lit("%")), "percent").when(ends("t", "trillion"), "trillions").when(ends("b", "billion"), "billions").when(ends("m", "million"), "millions").when(ends("k", "thousand"), "thousands")
    size = F.regexp_replace(core, "[^0-9.]", "").try_cast("double")
    value = F.when(negative, -size).otherwise(size)
    final = F.coalesce(found, F.lit("ones") if scale is None else F.coalesce(scale, F.lit("ones")))
    return F.struct(value.alias("value"), F.coalesce(sign, F.lit("USD") if unit is None else F.coalesce(unit, F.lit("USD"))).alias("unit"), final.alias("scale"), F.round(value * scale_multiplier(final), 6).alias("normalized"))


def formatted(raw: Column, amount: Column) -> Column:
    """An amount (of ``parse_amount``) for readers; the raw string where there is no number."""
    value, unit, scale = amount["value"], amount["unit"], amount["scale"]
    sign, size = F.when(value < 0, "-").otherwise(""), F.abs(value)
    dollar = F.when(unit == "USD", "$").otherwise("")
    code = F.when(unit != "USD", F.concat(F.lit(" "), unit)).otherwise("")
    shown = (
        F.when(scale == "percent", F.concat(sign, F.format_string("%.1f", size), F.lit("%")))
        .when(scale == "billions", F.concat(sign, dollar, F.format_string("%.2f", size), F.lit("B"), code))
        .when(scale == "millions", F.concat(sign, dollar, F.format_string("%.1f", size), F.lit("M"), code))
        .when(scale == "thousands", F.concat(sign, dollar, F.format_string("%,.0f", size), F.lit("K"), code))
        .otherwise(F.concat(sign, dollar, F.format_string("%,.2f", size), code))
    )
    return F.when(value.isNull(), raw).otherwise(shown)


def variance(base: Column, compare: Column, tolerance: float = 1e-4) -> Column:
    """struct(base_value, compare_value, absolute_change, percentage_change, trend)"""
    diff = compare - base
    flat = F.abs(diff) < tolerance
    percent = F.when(flat, 0.0).when(F.abs(base) > 1e-6, F.round(diff / F.abs(base) * 100.0, 2))
    trend = F.when(flat, "FLAT").when(diff > 0, "UP").otherwise("DOWN")
    return F.struct(F.round(base, 4).alias("base_value"), F.round(compare, 4).alias("compare_value"), F.round(diff, 4).alias("absolute_change"), percent.alias("percentage_change"), trend.alias("trend"))


def register(spark: SparkSession) -> None:
    """scale_multiplier, amount_value and pct_change as temporary SQL functions."""
    cases = " ".join(f"WHEN '{k}' THEN {v}D" for k, v in SCALES.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION scale_multiplier(s STRING) RETURNS DOUBLE RETURN CASE lower(trim(s)) {cases} ELSE 1.0D END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION amount_value(s STRING) RETURNS DOUBLE RETURN try_cast(regexp_replace(s, '[^0-9.]', '') AS DOUBLE) * IF(trim(s) RLIKE '^\\\\(.*\\\\)$' OR trim(s) LIKE '-%', -1, 1)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION pct_change(base DOUBLE, compare DOUBLE) RETURNS DOUBLE RETURN CASE WHEN abs(compare - base) < 1e-4 THEN 0.0D WHEN abs(base) > 1e-6 THEN round((compare - base) / abs(base) * 100, 2) END")
