"""Device sessions by event time: runs of fixes without a long gap, each with its own odometer.

The same function takes a table or a stream. A stream's fixes may come in any order within the watermark;
a session ends when the watermark has passed its last fix by the gap, and fixes that come later are
dropped and counted (`Progress.late`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.geo import haversine_m


def path_m(fixes: str) -> Column:
    """Metres along an array of (at, id, lat, lon), in its order."""
    whole = F.array_sort(fixes)
    legs = F.zip_with(F.slice(whole, 1, F.greatest(F.size(whole) - 1, F.lit(1))), F.slice(whole, 2, F.size(whole)), lambda a, b: F.coalesce(haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]), F.lit(0.0)))
    return F.aggregate(legs, F.lit(0.0), lambda total, leg: total + leg)


def device_sessions(fixes: DataFrame, by: str, key: str, gap: str, delay: str | None = None) -> DataFrame:
    """(by, first_at, last_at, fixes, metres) of fixes (by, key, at, lat, lon). A fix without a time is in no
    session. `delay` is a stream's watermark. A session's fixes are together in one row: some few a second."""
    timed = fixes.where(F.col("at").isNotNull())
    if delay is not None:
        timed = timed.withWatermark("at", delay)
    found = timed.groupBy(by, F.session_window("at", gap)).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("fixes"), F.collect_list(F.struct("at", key, "lat", "lon")).alias("_f"))
    return found.select(by, "first_at", "last_at", "fixes", path_m("_f").alias("metres"))
