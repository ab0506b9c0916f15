"""Salaries: structured, or read from text; a period is never guessed, and zero is no salary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanworks.functions import vocab


def number(c: Column) -> Column:
    return F.nullif(c.try_cast("double"), F.lit(0.0))


def salary(lo: Column, hi: Column, currency: Column, period: Column, basis: str = "stated") -> Column:
    """A struct of min, max, currency, period, basis; all null without a figure."""
    lo, hi = number(lo), number(hi)
    some = lo.isNotNull() | hi.isNotNull()
    return F.struct(
        lo.alias("salary_min"),
        F.coalesce(hi, lo).alias("salary_max"),
        F.when(some & (currency != ""), F.upper(currency)).alias("salary_currency"),
        F.when(some, vocab.salary_period(period)).alias("salary_period"),
        F.when(some, F.lit(basis)).alias("salary_basis"),
    )


def range_text(lo: Column, hi: Column) -> Column:
    """``$lo–$hi`` with thousands separators; one figure alone; else empty."""
    lo, hi = number(lo), number(hi)
    one = lambda x: F.concat(F.lit("$"), F.format_number(x, 0))
    return F.when(
        lo.isNotNull() & hi.isNotNull() & (lo != hi), F.concat(one(lo), F.lit("–"), one(hi))
    ).when(F.coalesce(lo, hi).isNotNull(), one(F.coalesce(lo, hi))).otherwise("")


def parsed(text: Column) -> Column:
    """``$120K–$150K a year`` and the like: figures with K or M, and a period that is said."""
    # How a figure, a range and a period are written.
    number_of = r"(?:[^\d\s]{0,3}\s?)?([\d,]+(?:\.\d+)?)\s*([KkMm])?"
    pattern = rf"(?i){number_of}\s*(?:[-–—]|to)?\s*(?:{number_of})?\s*(?:an?|per)\s+(hour|hr|week|wk|month|mo|year|yr|day)"
    part = lambda i: F.regexp_extract(F.coalesce(text, F.lit("")), pattern, i)
    scaled = lambda n, m: number(F.replace(part(n), F.lit(","), F.lit(""))) * F.when(F.lower(part(m)) == "k", 1_000.0).when(F.lower(part(m)) == "m", 1_000_000.0).otherwise(1.0)
    a, b = scaled(1, 2), scaled(3, 4)
    swap = a.isNotNull() & b.isNotNull() & (a > b)
    return salary(F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.lit("USD"), part(5), "parsed")
