"""Geography on a sphere, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Earth's radius and metres in a degree of latitude.
EARTH_M, DEGREE_M = 6371000.0, 111320.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; null where a coordinate is."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    root = F.sqrt(a)
    return 2 * EARTH_M * F.asin(F.when(root > 1, 1.0).otherwise(root))  # least() would take 1 for a null


def azimuth_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first point to the second, in [0, 360)."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))), F.lit(360.0))


def circular_mean_deg(angle: Column) -> Column:
    """Mean direction of a group, in [0, 360); null for an empty group."""
    return F.pmod(F.degrees(F.atan2(F.sum(F.sin(F.radians(angle))), F.sum(F.cos(F.radians(angle))))), F.lit(360.0))


def cardinal(angle: Column) -> Column:
    """north, east, south or west: quarters that start at 315 degrees."""
    return F.when((angle >= 315) | (angle < 45), "north").when(angle < 135, "east").when(angle < 225, "south").when(angle < 315, "west")


def even_pixels(value: Column, factor: Column) -> Column:
    """A scaled number of pixels, to the nearest even one, two at least; halves go up."""
    return F.greatest(F.lit(2), F.floor(value * factor / 2 + 0.5) * 2).cast("int")


def scaled_size(width: Column, height: Column, long_edge: int) -> tuple[Column, Column]:
    """A frame's size so that its longer side is long_edge; one that is not longer, or no limit, stays."""
    longest = F.greatest(width, height)
    stays = longest <= long_edge if long_edge > 0 else F.lit(True)
    return tuple(F.when(stays, v.cast("int")).otherwise(even_pixels(v, F.lit(float(long_edge)) / longest)) for v in (width, height))


def local_metres(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """East and north of an origin on a flat local map."""
    return (lon - lon0) * DEGREE_M * F.cos(F.radians(lat0)), (lat - lat0) * DEGREE_M


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment on a flat map."""
    dx, dy = bx - ax, by - ay
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / long))).otherwise(0.0)
    return F.hypot(x - (ax + t * dx), y - (ay + t * dy))
