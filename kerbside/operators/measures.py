"""Heights between an object's ends, planes moved to the ground, repeated trials, and what reviews are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.stats import NORMAL, counted, nearest_rank, share

#: A plane's unit normal and its offset.
Plane = tuple[float, float, float, float]


def above(plane: Plane) -> Column:
    """Signed height of (x, y, z) over the plane."""
    return F.col("x") * plane[0] + F.col("y") * plane[1] + F.col("z") * plane[2] + plane[3]


def ends(points: DataFrame, by: list[str], height: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Bottom and top of each group: percentiles at their nearest rank."""
    return points.groupBy(*by).agg(nearest_rank(height, low).alias("bottom"), nearest_rank(height, high).alias("top"), F.count(height).alias("n"))


def extent_with_doubt(points: DataFrame, by: list[str], height: str, band: float = 0.05, least: int = 200) -> DataFrame:
    """The extent of each group and its uncertainty: how much heights scatter in the bands round both ends.

    Groups of fewer than `least` heights have neither; a band of fewer than three adds no scatter.
    """
    found = ends(points, by, height)
    h = F.col(height)
    inside = lambda end: (h >= F.col(end) - band) & (h <= F.col(end) + band)
    both = F.array_compact(F.array(F.when(inside("bottom"), F.lit("bottom")), F.when(inside("top"), F.lit("top"))))
    near = points.join(found, by).select(*by, height, F.explode(both).alias("end"))
    middle = near.groupBy(*by, "end").agg(nearest_rank(height, 0.5).alias("middle"))
    off = near.join(middle, [*by, "end"]).withColumn("off", F.abs(h - F.col("middle")))
    scatter = off.groupBy(*by, "end").agg(F.when(F.count("*") >= 3, nearest_rank("off", 0.5) * NORMAL).otherwise(0.0).alias("scatter"))
    squares = scatter.groupBy(*by).agg(F.sqrt(F.sum(F.col("scatter") * F.col("scatter"))).alias("uncertainty"))
    enough = F.col("n") >= least
    return found.join(squares, by, "left").select(*by, "n", F.when(enough, F.col("top") - F.col("bottom")).alias("extent"), F.when(enough, F.col("uncertainty")).alias("uncertainty"))


def end_geometry(points: DataFrame, by: list[str], plane: Plane, band: float = 0.05) -> DataFrame:
    """Centroids of the points near both ends, how far they lie apart along and across the normal, and a
    ruler along the normal through the middle between them."""
    tall = points.withColumn("_h", above(plane))
    near = tall.join(ends(tall, by, "_h").drop("n"), by)
    mean = lambda c, end: F.avg(F.when(F.abs(F.col("_h") - F.col(end)) <= band, F.col(c)))
    both = near.groupBy(*by, "bottom", "top").agg(*(mean(c, end).alias(f"{end}_{c}") for end in ("bottom", "top") for c in "xyz"))
    delta = [F.col(f"top_{c}") - F.col(f"bottom_{c}") for c in "xyz"]
    along = sum((d * n for d, n in zip(delta, plane, strict=False)), F.lit(0.0))
    apart = sum((d * d for d in delta), F.lit(0.0))
    middle = [(F.col(f"top_{c}") + F.col(f"bottom_{c}")) / 2 for c in "xyz"]
    over = sum((m * n for m, n in zip(middle, plane, strict=False)), F.lit(plane[3]))
    ruler = {f"ruler_{end}_{c}": m + (F.col(end) - over) * n for end in ("bottom", "top") for c, m, n in zip("xyz", middle, plane, strict=False)}
    return both.withColumns({"distance": F.sqrt(apart), "lateral": F.sqrt(F.greatest(F.lit(0.0), apart - along * along)), **ruler})


def anchored(points: DataFrame, by: list[str], normal: tuple[float, float, float], low: float = 0.02, near: float = 0.035, deep: float = 0.05) -> DataFrame:
    """Each group's plane of a given normal, moved to a low percentile of its heights, and how points lie about it."""
    tall = points.withColumn("_h", above((*normal, 0.0)))
    level = tall.groupBy(*by).agg(nearest_rank("_h", low).alias("elevation"), F.count("_h").alias("n"))
    off = F.col("_h") - F.col("elevation")
    close = F.abs(off) <= near
    told = tall.join(level, by).groupBy(*by, "elevation", "n").agg(counted(close).alias("inliers"), F.sqrt(F.avg(F.when(close, off * off))).alias("rmse"), counted(off < -deep).alias("below"))
    return told.withColumns({"inlier_share": share(F.col("inliers"), F.col("n")), "below_share": share(F.col("below"), F.col("n"))}).drop("below")


def level_near(levels: DataFrame, wanted: DataFrame, by: list[str], tolerance: float = 0.15) -> DataFrame:
    """The level nearest each expected height, within the tolerance; of equals the one of most points, then
    the lowest. Null where there is none."""
    off = F.abs(F.col("level") - F.col("expected"))
    found = wanted.join(levels, by).where(off <= tolerance).groupBy(*by, "expected").agg(F.min_by("level", F.struct(off, -F.col("n"), "level")).alias("level"))
    return wanted.join(found, [*by, "expected"], "left")


def sitting_ranges(trials: DataFrame, by: str, sitting: str, value: str) -> DataFrame:
    """Ranges within and between sittings: the widest of sittings with two trials or more, and of the
    sittings' means where there are two. Trials without a sitting are one sitting."""
    of = trials.where(F.col(value).isNotNull()).groupBy(by, sitting).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("range"))
    return of.groupBy(by).agg(F.count("*").alias("sittings"), F.max(F.when(F.col("n") >= 2, F.col("range"))).alias("within"), F.when(F.count("*") >= 2, F.max("mean") - F.min("mean")).alias("between"))


def review_evidence(cells: DataFrame, by: list[str], key: str) -> DataFrame:
    """Counts of statuses, coverage, the range of heights, and cells to look at.

    The picks are the lowest, the one nearest the median, the highest, the least supported and the most
    disputed of the measured cells, then the first that abstained; a cell is listed for its first reason.
    """
    middle = cells.where("status = 'measured'").groupBy(*by).agg(nearest_rank("h95", 0.5).alias("_middle"))
    measured, h, k = F.col("status") == "measured", F.col("h95"), F.col(key)
    pick = lambda *order, of=measured: F.min(F.when(of, F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), k.alias("at"))))["at"]
    reasons = {
        "lowest": pick(h),
        "median": pick(F.abs(h - F.col("_middle"))),
        "highest": pick(-h),
        "least supported": pick(F.col("samples")),
        "most disputed": pick(-F.coalesce("spread", F.lit(0.0))),
        "abstained": pick(of=F.col("status") == "abstained"),
    }
    statuses = ("measured", "abstained", "canopy", "structure")
    g = cells.join(middle, by, "left").groupBy(*by).agg(
        F.count("*").alias("cells"),
        *(counted(F.col("status") == s).alias(s) for s in statuses),
        F.min(F.when(measured, h)).alias("lowest_h"),
        F.max(F.when(measured, h)).alias("highest_h"),
        F.array(*(F.struct(F.lit(r).alias("reason"), at.alias("at")) for r, at in reasons.items())).alias("_picks"),
    )
    firsts = F.filter("_picks", lambda p, i: p["at"].isNotNull() & (F.array_position(F.col("_picks.at"), p["at"]) == i + 1))
    listed = F.array_join(F.transform(firsts, lambda p: F.concat_ws(":", p["at"].cast("string"), p["reason"])), ",")
    return g.withColumns({"coverage": share(F.col("measured"), F.col("cells")), "picks": listed}).drop("_picks")


def readiness(sessions: DataFrame, segments: DataFrame) -> DataFrame:
    """A session is ready once as many segments are as its last index tells; without one it is not."""
    ready = segments.groupBy("session_id").agg(counted(F.col("state") == "ready").alias("n_ready"), F.count("*").alias("n_segments"))
    both = sessions.join(ready, "session_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_ready", "n_segments")})
    return both.withColumn("state", F.when(F.col("n_ready") == F.col("last_index") + 1, "ready").when(F.col("n_segments") > 0, "processing").otherwise("waiting"))
