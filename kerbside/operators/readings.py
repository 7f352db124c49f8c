"""The relation of readings and what is asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.levels import bucket
from kerbside.functions.stats import counted

COLUMNS = ["session_id", "segment_id", "window_index", "captured_at", "height", "cells", "level", "quality", "place", "measured_at", "start_m", "end_m"]
ORDERS = {
    "HEIGHT_DESC": ("height", "desc_nulls_last"),
    "HEIGHT_ASC": ("height", "asc_nulls_last"),
    "CAPTURED_DESC": ("captured_at", "desc"),
    "CAPTURED_ASC": ("captured_at", "asc"),
    "MEASURED_DESC": ("measured_at", "desc_nulls_last"),
}


def reading_source(segments: DataFrame, windows: DataFrame) -> DataFrame:
    """A row for each window, and for each measured segment that has none."""
    whole = segments.where(F.col("measured_at").isNotNull()).join(windows.select("segment_id"), "segment_id", "left_anti")
    whole = whole.withColumns({"window_index": F.lit(None).cast("int"), "start_m": F.lit(None).cast("double"), "end_m": F.lit(None).cast("double")})
    parts = windows.join(segments.select("session_id", "segment_id", "captured_at"), "segment_id")
    return whole.select(*COLUMNS).unionByName(parts.select(*COLUMNS))


def total_order(name: str) -> list[Column]:
    """The named order with the full key after it; an unknown name orders by height."""
    column, direction = ORDERS.get(name, ORDERS["HEIGHT_DESC"])
    return [getattr(F.col(column), direction)(), F.col("session_id").asc(), F.col("segment_id").asc(), F.coalesce("window_index", F.lit(-1)).asc()]


def page(df: DataFrame, order: str, limit: int = 25, offset: int = 0, most: int = 1000) -> DataFrame:
    """One page in a total order; limits outside 1..most are brought inside."""
    limit = 25 if limit <= 0 else min(limit, most)
    return df.orderBy(*total_order(order)).offset(max(offset, 0)).limit(limit)


def summary(readings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters of the filtered set in one pass; 0 for nothing, but an unknown height or length stays null."""
    levels = [counted(bucket(F.col("level")) == k).alias(f"level_{k}") for k in range(4)]
    good = [counted(F.col("quality") == q).alias(q) for q in ("good", "degraded")]
    rest = counted(F.coalesce(~F.col("quality").isin("good", "degraded"), F.lit(True))).alias("other")
    ranged = F.col("end_m").isNotNull() & F.col("start_m").isNotNull()
    return readings.groupBy(*(by or [])).agg(F.count("*").alias("total"), *levels, F.max("height").alias("tallest"), *good, rest, F.sum(F.col("end_m") - F.col("start_m")).alias("measured_metres"), counted(ranged).alias("ranged"))


def tallies(readings: DataFrame) -> DataFrame:
    return readings.groupBy("session_id").agg(F.count("*").alias("readings"), *(counted(bucket(F.col("level")) == k).alias(f"l{k}") for k in range(4)))


def first_place(readings: DataFrame) -> DataFrame:
    """A session's first placed reading, and how many places it has."""
    placed = readings.where(F.col("place").isNotNull())
    order = F.struct("segment_id", F.coalesce("window_index", F.lit(-1)))
    return placed.groupBy("session_id").agg(F.min_by("place", order).alias("place"), F.count_distinct("place").alias("places"))


def first_place_ranked(readings: DataFrame) -> DataFrame:
    """The same by ranking windows: the first row, and ranks from both ends."""
    placed = readings.where(F.col("place").isNotNull())
    rows = Window.partitionBy("session_id").orderBy("segment_id", F.coalesce("window_index", F.lit(-1)))
    up, down = (Window.partitionBy("session_id").orderBy(o) for o in (F.col("place").asc(), F.col("place").desc()))
    ranked = placed.withColumns({"r": F.row_number().over(rows), "places": (F.dense_rank().over(up) + F.dense_rank().over(down) - 1).cast("long")})
    return ranked.where("r = 1").select("session_id", "place", "places")


def session_list(sessions: DataFrame, readings: DataFrame, limit: int = 50) -> DataFrame:
    """Sessions with their tallies and first place, the most critical first."""
    placed = F.when(F.col("place").isNotNull(), F.struct("segment_id", F.coalesce("window_index", F.lit(-1))))
    told = readings.groupBy("session_id").agg(F.count("*").alias("readings"), *(counted(bucket(F.col("level")) == k).alias(f"l{k}") for k in range(4)), F.min_by("place", placed).alias("place"), F.count_distinct("place").alias("places"))
    out = sessions.join(told, "session_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("readings", "l0", "l1", "l2", "l3", "places")}
    return out.withColumns(zero).orderBy(F.desc("l3"), F.desc("l2"), F.desc_nulls_last("started_at"), F.desc("session_id")).limit(limit)


def window_rollup(windows: DataFrame) -> DataFrame:
    """The worst window of each segment: its values travel together, and an unknown level never wins."""
    worst = F.struct(F.col("level").isNotNull().cast("int"), F.coalesce("level", F.lit(0)), F.coalesce("height", F.lit(-1.0)), -F.col("window_index"))
    top = F.max_by(F.struct("level", "height", "window_index"), worst)
    return windows.groupBy("segment_id").agg(top.alias("w"), F.max("measured_at").alias("measured_at"), F.sum("cells").alias("cells")).select("segment_id", "w.level", "w.height", "w.window_index", "measured_at", "cells")


def with_child_counts(parents: DataFrame, children: DataFrame, key: str, **conditions: Column) -> DataFrame:
    """Parents with counts of their children, 0 for none."""
    counts = children.groupBy(key).agg(*(counted(c).alias(n) for n, c in conditions.items()))
    return parents.join(counts, key, "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in conditions})
