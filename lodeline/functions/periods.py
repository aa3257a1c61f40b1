"""Period grains: choice, buckets and filters that reach the scan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.columns import col

# Grains, their names, and the spans in days up to which the finer ones are chosen.
UNITS = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}
WEEKS_UP_TO, MONTHS_UP_TO = 120, 900
DAY_MICROS = 86_400_000_000


def bucket(date: str, grain: str) -> Column:
    """The start of the date's period; weeks start on Monday."""
    return F.date_trunc(UNITS[grain], col(date)).cast("timestamp_ntz")


def span_days(low: Column, high: Column) -> Column:
    """Whole elapsed days between two times."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(high) - micros(low)) / DAY_MICROS)


def grain_of(days: int | None) -> str:
    days = max(days or 0, 0)
    return "W" if days <= WEEKS_UP_TO else "M" if days <= MONTHS_UP_TO else "Q"


def preferred_grain(df: DataFrame, date: str) -> str:
    """The grain for the observed span: one aggregate over one column."""
    return grain_of(df.agg(span_days(F.min(col(date)), F.max(col(date))).alias("d")).first()["d"])


def in_year(date: str, year: int, month: int | None = None) -> Column:
    """A half-open range on the bare column, which scans can use to skip files."""
    low = datetime(year, month or 1, 1)
    high = datetime(year + 1, 1, 1) if month in (None, 12) else datetime(year, month + 1, 1)
    at = lambda t: F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return (col(date) >= at(low)) & (col(date) < at(high))


def in_scope(date: str, year: int | None, month: int | None) -> Column:
    if year:
        return in_year(date, year, month)
    return F.month(col(date)) == month
