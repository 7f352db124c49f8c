"""What lists show for a reading: its place, its state and its stretch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside.functions.text import blank_to_null, joined


def place_label(road: Column, km: Column, street: Column, lat: Column, lon: Column) -> Column:
    """Road and kilometre, else the street, else the coordinate; null for none of them."""
    marker = F.when(blank_to_null(road).isNotNull() & km.isNotNull(), F.concat(F.trim(road), F.lit(" km "), km.cast("string")))
    coordinate = F.concat(F.round(lat, 5).cast("decimal(9,5)").cast("string"), F.lit(", "), F.round(lon, 5).cast("decimal(9,5)").cast("string"))
    return F.coalesce(marker, blank_to_null(street), coordinate)


def place_detail(road: Column, km: Column, street: Column, number: Column, district: Column) -> Column:
    """The rest of a place: the street beside a kilometre, the number, which is never exact, and the district."""
    marker = blank_to_null(road).isNotNull() & km.isNotNull()
    return joined(", ", F.when(marker, street), F.concat(F.lit("about no. "), blank_to_null(number)), district)


def places_label(labels: Column) -> Column:
    """Of a group's distinct labels in order: the first, and how many more."""
    more = F.size(labels) - 1
    return F.when(more == 0, labels[0]).when(more > 0, F.concat(labels[0], F.lit(" and "), more.cast("string"), F.lit(" more")))


def reading_label(level: Column, measured: Column, abstained: Column) -> Column:
    """The level's name, or which of four cases leaves a reading without one."""
    named = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), level)
    nothing, unseen = (measured == 0) & (abstained == 0), (measured == 0) & (abstained > 0)
    return F.when(level.isin(1, 2, 3), named).when(nothing, "no vegetation found").when(unseen, "vegetation without a height").when(measured > 0, "too little evidence").otherwise("not assessed")


def stretch_key(session: Column, segment: Column, window: Column) -> Column:
    return F.concat_ws(":", session.cast("string"), segment.cast("string"), F.coalesce(window.cast("string"), F.lit("whole")))


def stretch_range(window: Column, start_m: Column, end_m: Column) -> Column:
    """Metres from and to of a window; null for a whole segment."""
    whole = lambda m: F.floor(m + 0.5).cast("string")
    return F.when(window.isNotNull(), F.concat(whole(start_m), F.lit("-"), whole(end_m), F.lit(" m")))
