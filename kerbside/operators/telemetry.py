"""Motion of a session from its fixes: distances, gates, windows of distance, bearings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.geo import azimuth_deg, circular_mean_deg, haversine_m

#: Metres of a distance window, frames it needs, frames it takes at most.
WINDOW_M, LEAST_FRAMES, MOST_FRAMES = 25.0, 64, 112
#: Metres that count as movement, and speed from which a course is believed.
LEAST_MOVE_M, COURSE_SPEED = 3.0, 2.0
#: Fixed value: metres between the ends of a drive from which their direction is its bearing.
BEARING_MOVE_M = 25.0


def ordered(*extra: str) -> Window:
    return Window.partitionBy("session_id").orderBy("t", *extra)


def usable(fixes: DataFrame) -> DataFrame:
    """Fixes whose clock does not run back behind any earlier one in order of arrival."""
    before = Window.partitionBy("session_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return fixes.withColumn("_m", F.max("t").over(before)).where(F.col("_m").isNull() | (F.col("t") >= F.col("_m"))).drop("_m")


def strictly_newer(fixes: DataFrame) -> DataFrame:
    """Fixes whose clock is ahead of all earlier ones in order of arrival: a receiver repeats its last fix until it
    has a new one."""
    before = Window.partitionBy("session_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return fixes.withColumn("_m", F.max("t").over(before)).where(F.col("_m").isNull() | (F.col("t") > F.col("_m"))).drop("_m")


def with_distance(fixes: DataFrame) -> DataFrame:
    """Metres travelled up to each fix: the trapezoid under the speeds, or between positions where no
    fix of the session moves."""
    o, whole = ordered("event_id"), Window.partitionBy("session_id")
    dt = (F.col("t") - F.lag("t").over(o)) / 1e9
    by_speed = dt * (F.col("speed") + F.lag("speed").over(o)) / 2
    by_place = haversine_m(F.lag("lat").over(o), F.lag("lon").over(o), F.col("lat"), F.col("lon"))
    step = F.when(F.max("speed").over(whole) > 0.01, by_speed).otherwise(by_place)
    return fixes.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("distance", F.sum("_s").over(o.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def distance_at(frames: DataFrame, profile: DataFrame) -> DataFrame:
    """Distance at each frame's time, straight between its neighbours and flat beyond the ends."""
    r = profile.groupBy("session_id", "t").agg(F.max("distance").alias("distance")).select("session_id", "t", F.lit(0).alias("side"), F.struct("t", "distance").alias("r"), F.lit(None).cast("long").alias("frame_id"))
    f = frames.select("session_id", "t", F.lit(1).alias("side"), F.lit(None).cast(r.schema["r"].dataType).alias("r"), "frame_id")
    o = Window.partitionBy("session_id").orderBy("t", "side")
    both = r.unionByName(f).withColumns({"b": F.last("r", ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, 0)), "a": F.first("r", ignorenulls=True).over(o.rowsBetween(0, Window.unboundedFollowing))}).where("side = 1")
    part = (F.col("t") - F.col("b.t")) / (F.col("a.t") - F.col("b.t"))
    between = F.col("b.distance") + part * (F.col("a.distance") - F.col("b.distance"))
    return both.select("session_id", "frame_id", "t", F.when(F.col("a").isNull(), F.col("b.distance")).when(F.col("b").isNull(), F.col("a.distance")).when(F.col("a.t") <= F.col("b.t"), F.col("b.distance")).otherwise(between).alias("distance"))


def motion_summary(profile: DataFrame) -> DataFrame:
    """Path, displacement, accuracy and whether the session moved."""
    first, last = F.min_by(F.struct("lat", "lon"), F.struct("t", "event_id")), F.max_by(F.struct("lat", "lon"), F.struct("t", "event_id"))
    m = profile.groupBy("session_id").agg(first.alias("f"), last.alias("l"), F.max("distance").alias("path"), F.median("accuracy").alias("accuracy"), F.count("*").alias("fixes"), F.max("speed").alias("top"))
    m = m.withColumn("displacement", haversine_m(F.col("f.lat"), F.col("f.lon"), F.col("l.lat"), F.col("l.lon")))
    floor = F.greatest(F.lit(LEAST_MOVE_M), 2 * F.col("accuracy"))
    return m.select("session_id", "path", "displacement", "accuracy", "fixes", F.when(F.col("top") > 0.01, F.col("path") >= LEAST_MOVE_M).otherwise(F.col("displacement") >= floor).alias("moved"))


def bearing(fixes: DataFrame) -> DataFrame:
    """The mean course of moving fixes; without any, the direction from the first fix to the last, if these
    are farther apart than BEARING_MOVE_M and three times the middle accuracy; else null. Negative courses
    are unknown ones."""
    course = circular_mean_deg(F.when((F.col("speed") >= COURSE_SPEED) & (F.col("course") >= 0), F.col("course")))
    first, last = F.min_by(F.struct("lat", "lon"), F.struct("t", "event_id")), F.max_by(F.struct("lat", "lon"), F.struct("t", "event_id"))
    g = fixes.groupBy("session_id").agg(course.alias("c"), first.alias("f"), last.alias("l"), F.median("accuracy").alias("accuracy"))
    ends = (F.col("f.lat"), F.col("f.lon"), F.col("l.lat"), F.col("l.lon"))
    far = haversine_m(*ends) >= F.greatest(F.lit(BEARING_MOVE_M), 3 * F.col("accuracy"))
    return g.select("session_id", F.coalesce("c", F.when(far, azimuth_deg(*ends))).alias("bearing"))


def distance_windows(frames: DataFrame, length: float = WINDOW_M, least: int = LEAST_FRAMES) -> DataFrame:
    """Equal windows of each session's distance, as many as metres and frames allow; both ends are in,
    so a frame on a border is in two windows. Windows of one frame go."""
    s = frames.groupBy("session_id").agg(F.min("distance").alias("d0"), F.max("distance").alias("d1"), F.count("*").alias("n"))
    count = F.greatest(F.lit(1), F.least(F.ceil((F.col("d1") - F.col("d0")) / length - 1e-9), F.floor(F.col("n") / least))).cast("int")
    s = s.withColumn("count", count).withColumn("size", (F.col("d1") - F.col("d0")) / F.col("count"))
    at = frames.join(s, "session_id")
    low = F.greatest(F.lit(0), F.floor((F.col("distance") - F.col("d0")) / F.col("size")) - 1)
    near = at.withColumn("w", F.explode(F.when(F.col("size") > 0, F.sequence(low.cast("int"), F.least(F.col("count") - 1, low.cast("int") + 2))).otherwise(F.array(F.lit(0)))))
    start, end = F.col("d0") + F.col("w") * F.col("size"), F.col("d0") + (F.col("w") + 1) * F.col("size")
    inside = near.where((F.col("size") == 0) | ((F.col("distance") >= start) & (F.col("distance") <= end)))
    return inside.groupBy("session_id", "w").agg(F.count("*").alias("frames"), F.min("distance").alias("start_m"), F.max("distance").alias("end_m")).where("frames >= 2")


def pack(groups: DataFrame, keys: list[str], order: str, size: str, most: int) -> DataFrame:
    """Number the packs that consecutive groups fill greedily: a group that does not fit starts a new pack.

    The fold runs over the sorted groups of one key, which are as many as a drive has windows.
    """
    listed = groups.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("g"))
    empty = F.struct(F.array().cast("array<struct<o:bigint,pack:int>>").alias("out"), F.lit(-1).alias("pack"), F.lit(0).cast("long").alias("held"))

    def put(acc, g):
        fits = (acc["pack"] >= 0) & (acc["held"] + g["s"] <= most)
        number = F.when(fits, acc["pack"]).otherwise(acc["pack"] + 1)
        return F.struct(F.concat(acc["out"], F.array(F.struct(g["o"].cast("bigint").alias("o"), number.alias("pack")))).alias("out"), number.alias("pack"), F.when(fits, acc["held"] + g["s"]).otherwise(g["s"]).alias("held"))

    return listed.select(*keys, F.explode(F.aggregate("g", empty, put, lambda a: a["out"])).alias("p")).select(*keys, F.col("p.o").alias(order), "p.pack")


def even_selection(frames: DataFrame, count: int) -> DataFrame:
    """Of each session the frames nearest to `count` evenly spaced distances, each once, in order."""
    from kerbside.operators.asof import nearest

    ends = frames.groupBy("session_id").agg(F.min("distance").alias("d0"), F.max("distance").alias("d1"))
    k = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    targets = k.select("session_id", "k", (F.col("d0") + (F.col("d1") - F.col("d0")) * F.col("k") / max(count - 1, 1)).alias("distance"))
    near = nearest(targets, frames.select("session_id", "distance", "frame_id"), ["session_id"], "distance", ["frame_id"], "frame_id")
    return near.groupBy("session_id", "frame_id").agg(F.min("k").alias("k"))


def thinned(path: DataFrame, key: str, order: str, least_m: float = 0.5) -> DataFrame:
    """Vertices (x, y) of a path at least least_m from the last one kept; a fold over one path's vertices."""
    listed = path.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), "x", "y"))).alias("v"))
    kind = "array<struct<o:bigint,x:double,y:double>>"

    def put(kept, v):
        last = F.element_at(kept, -1)
        return F.when(F.size(kept) == 0, F.array(v)).when(F.hypot(v["x"] - last["x"], v["y"] - last["y"]) >= least_m, F.concat(kept, F.array(v))).otherwise(kept)

    return listed.select(key, F.explode(F.aggregate(F.col("v").cast(kind), F.array().cast(kind), put)).alias("p")).select(key, F.col("p.o").alias(order), "p.x", "p.y")
