"""Surfaces above a ground plane, heights of objects over it, and what pixels' class scores say stands there.

A plane comes as a row for each cloud: (by, nx, ny, nz, offset) with a unit normal, and where it says so rmse.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import vectors
from kerbside.functions.stats import NORMAL, counted, nearest_rank
from kerbside.operators.stages import cut


class Peaks(NamedTuple):
    """Metres, but for the shares and the prominence (times the median of the bins around)."""

    bin_m: float = 0.005
    low: float = -0.25
    high: float = 3.0
    apart: float = 0.05
    half_band: float = 0.02
    least_share: float = 0.002
    least_prominence: float = 2.0
    least_extent: float = 0.05


def over_plane(points: DataFrame, planes: DataFrame, by: str) -> DataFrame:
    """Points (by, x, y, z) with their signed height h over their cloud's plane, and their place (u, v) along it. A
    point of a cloud without a plane, or that is nowhere, is left out."""
    n = vectors.vector(*(F.col(f"n{c}") for c in "xyz"))
    axes = planes.withColumn("_s", vectors.across(n)).select(by, "nx", "ny", "nz", "offset", *(F.col(f"_s.{k}.{c}").alias(f"{a}{c}") for a, k in (("a", "first"), ("b", "second")) for c in "xyz"))
    along = lambda a: F.col("x") * F.col(f"{a}x") + F.col("y") * F.col(f"{a}y") + F.col("z") * F.col(f"{a}z")
    at = points.join(axes, by).withColumns({"h": along("n") + F.col("offset"), "u": along("a"), "v": along("b")})
    return at.where(F.abs("h") < float("inf")).select(*points.columns, "h", "u", "v")


def spread(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """The median absolute deviation of each group, scaled to a normal's."""
    middle = df.groupBy(*keys).agg(nearest_rank(column, 0.5).alias("_m"))
    off = df.join(middle, keys).withColumn("_o", F.abs(F.col(column) - F.col("_m")))
    return off.groupBy(*keys).agg((nearest_rank("_o", 0.5) * NORMAL).alias(name))


def levels(points: DataFrame, planes: DataFrame, by: str, o: Peaks = Peaks()) -> DataFrame:
    """Horizontal surfaces of each cloud: (by, rank, height, points, share, thickness, prominence, extent), the one of
    the most points first, the lower of equals.

    A bin of heights is a peak if none within reach holds more, the lower of equals, and it stands out from the
    median of the other bins there that hold something. The points near its middle are the surface; it must
    be as wide as least_extent both ways. Bins are summed before they meet, so a cloud may be of any size.
    """
    every = cut(over_plane(points, planes, by))
    total = every.groupBy(by).agg(F.count("*").alias("total"))
    inside = every.where((F.col("h") >= o.low) & (F.col("h") < o.high))
    last = max(1, math.ceil((o.high - o.low) / o.bin_m - 1e-9)) - 1
    bins = inside.groupBy(by, F.least(F.lit(last), F.floor((F.col("h") - o.low) / o.bin_m)).alias("bin")).agg(F.count("*").alias("n"))
    reach = max(1, round(o.apart / o.bin_m))
    w = Window.partitionBy(by).orderBy("bin")
    before, after = w.rangeBetween(-reach, -1), w.rangeBetween(1, reach)
    around = F.concat(F.coalesce(F.collect_list("n").over(before), F.array()), F.coalesce(F.collect_list("n").over(after), F.array()))
    near = bins.withColumns({"_b": F.coalesce(F.max("n").over(before), F.lit(0)), "_a": F.coalesce(F.max("n").over(after), F.lit(0)), "_n": F.array_sort(around)})
    middle = F.try_element_at("_n", F.ceil(F.size("_n") / 2).cast("int"))
    peaks = near.where((F.col("n") > F.col("_b")) & (F.col("n") >= F.col("_a")) & (F.size("_n") > 0)).withColumn("prominence", F.col("n") / F.greatest(F.lit(1), middle)).where(F.col("prominence") >= o.least_prominence)
    centre = o.low + (F.col("bin") + 0.5) * o.bin_m
    few = peaks.select(by, "bin", "prominence", (centre - o.half_band).alias("_from"), (centre + o.half_band).alias("_to"))
    band = cut(inside.join(few, by).where((F.col("h") >= F.col("_from")) & (F.col("h") < F.col("_to"))))
    keys = [by, "bin"]
    told = band.groupBy(*keys).agg(F.first("prominence").alias("prominence"), F.count("*").alias("points"), nearest_rank("h", 0.5).alias("height"))
    told = told.join(total, by).withColumn("share", F.col("points") / F.col("total")).where(F.col("share") >= o.least_share)
    for column, name in (("h", "thickness"), ("u", "_u"), ("v", "_v")):
        told = told.join(spread(band, keys, column, name), keys)
    told = told.withColumn("extent", F.least("_u", "_v")).where(F.col("extent") >= o.least_extent)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("points"), "bin"))
    return told.select(by, rank.cast("long").alias("rank"), "height", "points", "share", "thickness", "prominence", "extent")


def object_heights(points: DataFrame, planes: DataFrame, by: str, high: float = 0.98, band: float = 0.05, least: int = 200) -> DataFrame:
    """How tall each object is over its plane: a high percentile, and how sure that is: the scatter of the points
    near the top (three or more) and the plane's rmse, squared together. Fewer points than `least` tell nothing."""
    at = cut(over_plane(points, planes, by))
    top = at.groupBy(by).agg(F.count("*").alias("points"), nearest_rank("h", high).alias("_top"), F.max("h").alias("_most"))
    near = at.join(top, by).where((F.col("h") >= F.col("_top") - band) & (F.col("h") <= F.col("_top") + band))
    counts = near.groupBy(by).agg(F.count("*").alias("top_points"))
    told = planes.select(by, F.coalesce("rmse", F.lit(0.0)).alias("_rmse")).join(top, by, "left").join(counts, by, "left").join(spread(near, [by], "h", "_r"), by, "left")
    points_ = F.coalesce("points", F.lit(0))
    enough = points_ >= least
    rough = F.when(F.col("top_points") >= 3, F.col("_r"))
    return told.select(
        by, points_.alias("points"), F.when(enough, F.col("_top")).alias("height"), F.when(enough, F.hypot(F.coalesce(rough, F.lit(0.0)), F.col("_rmse"))).alias("uncertainty"),
        F.when(enough, rough).alias("roughness"), F.when(enough, F.col("top_points")).alias("top_points"), F.when(enough, F.col("_most")).alias("tallest"), F.when(~enough, "too few points").alias("failure"),
    )


def softmax(scores: Column) -> Column:
    return vectors.let(F.array_max(scores), lambda top: vectors.let(F.transform(scores, lambda v: F.exp(v - top)), lambda e: vectors.let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(e, lambda v: v / total))))


def structure_share(kind: str, scores: Column, classes: list[int]) -> Column:
    """How much of a pixel is structure, 0 to 1.

    "classes": the structure classes' part of the softmax of the scores; "queries": their part of the mass that
    queries lay on the pixel (0 for none); "prompts": what the phrase that fits best says, whatever it is.
    """
    part = lambda s: sum((F.coalesce(F.try_element_at(s, F.lit(k + 1)), F.lit(0.0)) for k in classes), F.lit(0.0))
    if kind == "classes":
        return vectors.let(softmax(scores), part)
    if kind == "queries":
        total = F.aggregate(scores, F.lit(0.0), lambda a, v: a + v)
        return F.when(total > 0, part(scores) / total).otherwise(0.0)
    if kind == "prompts":
        return F.greatest(F.lit(0.0), F.array_max(scores))
    raise ValueError(f"no such kind of model: {kind}")


def structure_masks(pixels: DataFrame, models: list[tuple[str, str, list[int], float, str]]) -> DataFrame:
    """Pixels with whether each use sees a structure: `structure` (leaves the grass mask), `vote_only` (stays in it
    and votes), `band_only` (leaves only the copy that places the band).

    A model is (kind, column of scores, classes, least share, use: always, vote or band).
    """
    sees = [(use, structure_share(kind, F.col(column), classes) >= floor) for kind, column, classes, floor, use in models]
    any_of = lambda uses: F.coalesce(F.greatest(F.lit(False), F.lit(False), *(s for u, s in sees if u in uses)), F.lit(False))
    return pixels.withColumns({"structure": any_of({"always"}), "vote_only": any_of({"vote", "band"}), "band_only": any_of({"band"})})


def grass_mask(pixels: DataFrame, scores: str, roles: list[str], least: float = 0.5) -> DataFrame:
    """Pixels with their class (the first of equal scores), its probability, and whether that makes them grass."""
    best = F.array_position(scores, F.array_max(scores)) - 1
    at = pixels.withColumns({"class": best.cast("int"), "probability": F.array_max(softmax(F.col(scores)))})
    role = F.try_element_at(F.array(*map(F.lit, roles)), F.col("class") + 1)
    wins = at.withColumn("wins", F.coalesce(role == "grass", F.lit(False)))
    return wins.withColumn("grass", F.coalesce(F.col("wins") & (F.col("probability") >= least), F.lit(False)))


def mask_counts(masked: DataFrame, by: list[str]) -> DataFrame:
    """Of grass_mask()'s pixels: how many there are, are grass by class, are kept, and fall below the probability."""
    told = masked.groupBy(*by).agg(F.count("*").alias("total"), counted(F.col("wins")).alias("grass_wins"), counted(F.col("grass")).alias("kept"))
    return told.withColumn("dropped", F.col("grass_wins") - F.col("kept"))
