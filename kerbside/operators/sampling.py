"""How a segment's frames are sampled: what its telemetry decides, and what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.operators.telemetry import LEAST_MOVE_M

#: Share of the duration that fixes must span, metres a second that the motion floor may ask
#: for, and what makes a graded window.
LEAST_SPAN, FLOOR_SPEED = 0.5, 2.78
GRADED_FRAMES, GRADED_M = 64, (14.0, 25.0)


def rebased(df: DataFrame, start: str = "start_t") -> DataFrame:
    """Clocks counted from the segment's own start."""
    return df.withColumn("t", F.col("t") - F.col(start))


def telemetry_decides(fixes: str = "fixes", span_s: str = "span_s", duration_s: str = "duration_s", accuracy: str = "accuracy") -> Column:
    """Whether distance, not time, picks the frames: enough fixes over enough of the segment, and a motion
    floor that a car of that duration could pass."""
    floor = F.greatest(F.lit(LEAST_MOVE_M), 2 * F.col(accuracy))
    return F.coalesce((F.col(fixes) >= 2) & (F.col(span_s) >= LEAST_SPAN * F.col(duration_s)) & (floor <= FLOOR_SPEED * F.col(duration_s)), F.lit(False))


def strategy(moved: Column) -> Column:
    """The name of the way in which frames are sampled."""
    by_telemetry = F.when(F.coalesce(moved, F.lit(False)), "distance-groups").otherwise("insufficient-motion")
    return F.when(F.coalesce(F.col("fixes"), F.lit(0)) == 0, "time-uniform-no-telemetry").when(telemetry_decides(), by_telemetry).otherwise("time-uniform-sparse-telemetry")


def is_graded() -> Column:
    """Whether a window of frames and length_m has enough of both."""
    return (F.col("frames") >= GRADED_FRAMES) & F.col("length_m").between(*GRADED_M)


def route_identity(derived: DataFrame, declared: DataFrame, key: str, names: list[str]) -> DataFrame:
    """What was derived wins; what was declared fills."""
    other = declared.select(key, *(F.col(n).alias(f"_{n}") for n in names))
    return derived.join(other, key, "full").select(key, *(F.coalesce(n, f"_{n}").alias(n) for n in names))


def uniform_plan(fps: str, duration_s: str, most: int) -> dict[str, Column]:
    """Frames of a plan by time, `most` at most, and the rate that they come to."""
    frames = F.least(F.floor(F.col(fps) * F.col(duration_s)), F.lit(most))
    return {"frames": frames, "effective_fps": F.when(F.col(duration_s) > 0, F.least(F.col(fps), frames / F.col(duration_s)))}


def sampled_length(frames: DataFrame, key: str = "session_id") -> DataFrame:
    """Metres from the first to the last sampled frame; null unless distance picked them and never runs back."""
    back = F.col("distance") < F.lag("distance").over(Window.partitionBy(key).orderBy("k"))
    g = frames.withColumn("_back", F.coalesce(back, F.lit(False))).groupBy(key).agg(F.bool_or("_back").alias("back"), F.first("strategy").alias("s"), F.min_by("distance", "k").alias("d0"), F.max_by("distance", "k").alias("d1"))
    return g.select(key, F.when(~F.col("back") & (F.col("s") == "distance-groups"), F.col("d1") - F.col("d0")).alias("length_m"))


def baselines(frames: DataFrame, key: str = "session_id") -> DataFrame:
    """Distances between neighbouring sampled frames: least, middle and most."""
    step = F.col("distance") - F.lag("distance").over(Window.partitionBy(key).orderBy("k"))
    return frames.withColumn("_d", step).groupBy(key).agg(F.count("_d").alias("steps"), F.min("_d").alias("least_m"), F.median("_d").alias("median_m"), F.max("_d").alias("most_m"))


def travel_direction(poses: DataFrame, key: str, order: str, reach: int = 3) -> DataFrame:
    """At each pose the vector from `reach` poses before to as many after, cut off at both ends."""
    o = Window.partitionBy(key).orderBy(order)
    whole = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = {a: F.coalesce(F.lead(a, reach).over(o), F.last(a).over(whole)) - F.coalesce(F.lag(a, reach).over(o), F.first(a).over(whole)) for a in ("x", "y", "z")}
    size = F.sqrt(sum((v * v for v in d.values()), F.lit(0.0)))
    return poses.select(key, order, *(F.when(size > 0, v / size).alias(f"d{a}") for a, v in d.items()))


def nearest_pose(points: DataFrame, poses: DataFrame, key: str, point: str, order: str, at_most: int = 24) -> DataFrame:
    """Each point's nearest pose of its key's track, of which about `at_most` evenly strided poses count.

    A track gives that many poses at most, so they travel as one array with each point.
    """
    o = Window.partitionBy(key)
    stride = F.greatest(F.lit(1), F.floor(F.count("*").over(o) / at_most))
    row = F.row_number().over(o.orderBy(order)) - 1
    strided = poses.withColumns({"_row": row, "_stride": stride}).where("_row % _stride = 0")
    tracks = strided.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "x", "y", "z"))).alias("_track"))
    far = lambda p: (p["x"] - F.col("x")) ** 2 + (p["y"] - F.col("y")) ** 2 + (p["z"] - F.col("z")) ** 2
    best = F.array_min(F.transform("_track", lambda p: F.struct(far(p).alias("d"), p["o"].alias("o"))))
    return points.join(tracks, key).select(key, point, best["o"].alias("pose"), best["d"].alias("squared"))


def closest_by_index(wanted: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """Each wanted index with the frame whose index is closest, the first of equals."""
    listed = frames.groupBy(key).agg(F.array_sort(F.collect_set("index")).alias("_all"))
    best = F.array_min(F.transform("_all", lambda i: F.struct(F.abs(i - F.col("wanted")).alias("d"), i.alias("i"))))
    return wanted.join(listed, key, "left").select(key, "wanted", best["i"].alias("index"))


def even_numbers(frames: Column, of: int = 256) -> Column:
    """The numbers (from 1) of so many frames picked evenly from `of`; all of their own where they are as many or more."""
    last = F.greatest(frames - 1, F.lit(1))
    picked = F.transform(F.sequence(F.lit(0), F.greatest(frames - 1, F.lit(0))), lambda i: F.floor(i * (of - 1) / last + 0.5).cast("int") + 1)
    own = F.transform(F.sequence(F.lit(1), F.greatest(frames, F.lit(1))), lambda i: i.cast("int"))
    return F.when(frames >= of, own).when(frames <= 0, F.array().cast("array<int>")).otherwise(picked)
