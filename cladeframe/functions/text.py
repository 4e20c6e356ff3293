"""Texts of report tables, and the clipped logit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 1e-12


def percent(share: Column) -> Column:
    """One decimal and a percent sign."""
    return F.format_string("%.1f%%", share * 100.0)


def six_significant(x: Column) -> Column:
    """Six significant digits, trailing zeros dropped, exponents below 1e-4 and from 1e6."""
    size = F.floor(F.log10(F.abs(x)))
    plain = F.regexp_replace(F.regexp_replace(F.round(x, 12).cast("decimal(38,12)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    rounded = F.format_string("%.5e", x).cast("double")
    science = F.regexp_replace(F.format_string("%.5e", x), r"\.?0+e", "e")
    fixed = F.regexp_replace(F.regexp_replace(rounded.cast("decimal(38,12)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(x == 0, "0").when((size < -4) | (size >= 6), science).when(x.isNotNull(), F.coalesce(fixed, plain))


def truth(x: Column) -> Column:
    return F.when(x, "True").when(~x, "False")


def quartile_text(low: Column, high: Column, places: int = 3) -> Column:
    """The interquartile range as ``q1-q3``."""
    return F.concat(F.round(low, places).cast("string"), F.lit("-"), F.round(high, places).cast("string"))


def logit(p: Column) -> Column:
    """ln(p / (1 - p)) with p kept off 0 and 1."""
    q = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.ln(q / (1 - q))


def inverse_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
