"""Dates of postings: strings of the shape YYYY-MM-DD, read against an explicit day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"


def epoch_date(seconds_or_millis: Column) -> Column:
    """The New York date of an epoch in seconds, or in milliseconds beyond 1e11."""
    x = seconds_or_millis.cast("double")
    seconds = F.when(x > 1e11, x / 1000).otherwise(x)
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), ZONE), "yyyy-MM-dd")


def to_date(raw: Column) -> Column:
    """Epoch text or the first ten characters if they have the shape; else empty."""
    s = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    return F.when(s.rlike(r"^\d+(\.\d+)?$"), epoch_date(s.try_cast("double"))).when(
        F.left(s, F.lit(10)).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.left(s, F.lit(10))
    ).otherwise("")


def age_days(posted: Column, as_of: Column) -> Column:
    """Whole days up to as_of; null for what is no date."""
    return F.datediff(as_of, posted.try_cast("date"))


def stale_penalty(age: Column, stale_after: int = 30) -> Column:
    """Two for each ten days beyond stale_after, twelve at most."""
    return F.when(age > stale_after, F.least(F.lit(12), (F.floor((age - stale_after) / 10) * 2).cast("int"))).otherwise(0)


def relative_date(phrase: Column, as_of: Column) -> Column:
    """``Posted N day(s)/week(s)/month(s) ago``, today, yesterday; a month is 30 days; else null."""
    low = F.lower(phrase)
    n = F.regexp_extract(low, r"(\d+)\+?\s*(day|week|month)", 1).try_cast("int")
    unit = F.regexp_extract(low, r"(\d+)\+?\s*(day|week|month)", 2)
    days = n * F.when(unit == "week", 7).when(unit == "month", 30).otherwise(1)
    back = F.when(low.contains("today") | low.contains("just posted"), 0).when(low.contains("yesterday"), 1).when(n.isNotNull(), days)
    return F.date_format(F.date_sub(as_of.cast("date"), back), "yyyy-MM-dd")
