"""Days, weeks and instants. Instants are UTC; days are those of a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_key(at: Column, zone: str = "UTC") -> Column:
    """The day of an instant where a zone's clock stands, as text that sorts."""
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd")


def week_start(at: Column, zone: str = "UTC") -> Column:
    """The Monday of an instant's week."""
    return F.date_trunc("week", F.from_utc_timestamp(at, zone)).cast("date")


def month_key(at: Column) -> Column:
    """yyyyMM in UTC."""
    return F.date_format(at, "yyyyMM")


def day_bounds(first: Column, last: Column, zone: str = "UTC") -> tuple[Column, Column]:
    """The instants that days `first` to `last` (text or dates; null for no bound) begin and have ended at."""
    begin = F.to_utc_timestamp(F.to_timestamp(first.cast("date")), zone)
    return begin, F.to_utc_timestamp(F.to_timestamp(F.date_add(last.cast("date"), 1)), zone)


def instant_after(base: Column, nanos: Column) -> Column:
    """An instant so many nanoseconds after another; what is less than a microsecond is cut off."""
    return F.timestamp_micros(F.unix_micros(base) + F.floor(nanos / 1000).cast("long"))
