"""Exact decimal text: parsing notice amounts and printing results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,10)"
RATE = "decimal(9,6)"


def parse_amount(col: Column) -> Column:
    """'1.234,50' -> '1234.50' (kept as text so the written scale survives)."""
    return F.replace(F.replace(col, F.lit("."), F.lit("")), F.lit(","), F.lit("."))


def scale_of(col: Column) -> Column:
    """Number of digits after the point of a plain decimal string."""
    return F.length(F.regexp_extract(col, r"\.(\d*)$", 1))


def stripped(col: Column) -> Column:
    """Plain decimal string without trailing fraction zeros ('10.00' -> '10')."""
    return F.when(
        col.contains("."), F.rtrim(F.rtrim(col, F.lit("0")), F.lit("."))
    ).otherwise(col)


def decimal_text(col: Column) -> Column:
    """Decimal string as printed in records: scientific below 1e-6, plain otherwise."""
    sign = F.when(col.startswith("-"), "-").otherwise("")
    digits = F.ltrim(F.regexp_replace(col, r"[^0-9]", ""), F.lit("0"))
    scale = scale_of(col)
    significant = F.when(digits == "", "0").otherwise(digits)
    adjusted = F.length(significant) - 1 - scale
    mantissa = F.when(F.length(significant) == 1, significant).otherwise(
        F.concat(
            F.substring(significant, 1, 1), F.lit("."), significant.substr(F.lit(2), F.length(significant))
        )
    )
    return F.when(
        adjusted < -6, F.concat(sign, mantissa, F.lit("E"), adjusted.cast("string"))
    ).otherwise(col)


def plain_text(col: Column) -> Column:
    """Text of :func:`decimal_text` without exponent ('8.50E-7' -> '0.000000850'); any other text as it is."""
    scientific = r"^(-?)(\d)(?:\.(\d+))?E-(\d+)$"
    digits = F.concat(F.regexp_extract(col, scientific, 2), F.regexp_extract(col, scientific, 3))
    scale = F.length(digits) - 1 + F.regexp_extract(col, scientific, 4).try_cast("int")
    plain = F.concat(F.regexp_extract(col, scientific, 1), F.lit("0."), F.lpad(digits, scale, F.lit("0")))
    return F.when(col.rlike(scientific), plain).otherwise(col)


def half_even(col: Column) -> Column:
    """Round a double to the nearest integer, ties to even."""
    return F.bround(col.cast("double"), 0).cast("int")
