"""Salaries out of free text and back into text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _number(numbers: Column, position: int) -> Column:
    return F.get(numbers, F.lit(position)).try_cast("double")


def parse_salary(c: Column) -> Column:
    """Struct(min, max, currency) of text such as ``$80,000 - $120,000`` or ``€60k-80k``.

    One number is both minimum and maximum; with a "k" anywhere, numbers below 1000 are
    thousands. Text without numbers gives nulls, the currency included.
    """
    numbers = F.regexp_extract_all(F.replace(c, F.lit(","), F.lit("")), F.lit(r"(\d+\.?\d*)"), F.lit(1))
    thousands = F.contains(F.lower(c), F.lit("k"))

    def scaled(value: Column) -> Column:
        return F.when(thousands & (value < 1000), value * 1000).otherwise(value)

    low = scaled(_number(numbers, 0))
    high = scaled(F.coalesce(_number(numbers, 1), _number(numbers, 0)))
    currency = F.when(F.contains(c, F.lit("$")), "USD").when(F.contains(c, F.lit("€")), "EUR").when(
        F.contains(c, F.lit("£")), "GBP"
    )
    return F.struct(
        low.alias("min"), high.alias("max"), F.when(low.isNotNull(), currency).alias("currency")
    )


def parse_salary_lpa(c: Column) -> Column:
    """Struct(min, max) of Indian notation such as ``15-25 LPA``, ``10L - 20L`` or ``1.2 Cr``.

    The unit must be a unit: an "l" somewhere in the text is not taken for lakh.
    """
    numbers = F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    unit = (
        F.when(c.rlike(r"(?i)lpa|lac|lakh|\dl\b|\d\s+l\b"), F.lit(100000.0))
        .when(c.rlike(r"(?i)cr"), F.lit(10000000.0))
        .otherwise(F.lit(1.0))
    )
    return F.struct((_number(numbers, 0) * unit).alias("min"), (_number(numbers, 1) * unit).alias("max"))


def format_salary(low: Column, high: Column, currency: Column) -> Column:
    """``EUR 50,000 - 70,000``, ``EUR 50,000+`` or ``Not specified``; zero counts as missing."""
    has_low, has_high = F.coalesce(low, F.lit(0.0)) != 0, F.coalesce(high, F.lit(0.0)) != 0
    money = F.coalesce(currency, F.lit(""))
    return (
        F.when(has_low & has_high, F.concat(money, F.lit(" "), F.format_number(low, 0), F.lit(" - "), F.format_number(high, 0)))
        .when(has_low, F.concat(money, F.lit(" "), F.format_number(low, 0), F.lit("+")))
        .otherwise(F.lit("Not specified"))
    )


def salary_missing(low: Column, high: Column) -> Column:
    """Neither bound is given; zero counts as missing."""
    return (F.coalesce(low, F.lit(0.0)) == 0) & (F.coalesce(high, F.lit(0.0)) == 0)

