"""Work orders, teams and the dashboards over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.geo import haversine_m
from kerbside.functions.stats import counted, share


def team_workload(teams: DataFrame, orders: DataFrame) -> DataFrame:
    """Counts of each team's orders by status, 0 for none; teams are few, so their side decides nothing."""
    counts = orders.groupBy("team_id").agg(*(counted(F.col("status") == s).alias(f"n_{s}") for s in ("open", "scheduled", "done")))
    return teams.join(counts, "team_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_open", "n_scheduled", "n_done")})


def nested_page(orders: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    """The newest orders with their targets as a sorted list, empty for none."""
    top = orders.orderBy(F.desc("created_at"), F.desc("order_id")).limit(limit)
    listed = targets.join(F.broadcast(top.select("order_id")), "order_id").groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct("position", "window_level"))).alias("targets"))
    return top.join(listed, "order_id", "left").withColumn("targets", F.coalesce("targets", F.array().cast(listed.schema["targets"].dataType)))


def with_history(page: DataFrame, events: DataFrame) -> DataFrame:
    """A page of orders with their events (order_id, event_id, at, status, note) as a list in the order of time."""
    listed = events.join(F.broadcast(page.select("order_id")), "order_id").groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct("at", "event_id", "status", "note"))).alias("events"))
    return page.join(listed, "order_id", "left").withColumn("events", F.coalesce("events", F.array().cast(listed.schema["events"].dataType)))


def opened(drafts: DataFrame, targets: DataFrame, readings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders of drafts (order_id, opened_at, ...) with their evidence as it is now, the event that opens each, and
    the targets that keep a draft from being opened.

    Targets are (order_id, position, session_id, segment_id, window_index); readings are measured ones with
    those keys, level, place, start_m, end_m, lat and lon. A draft without targets, or with one that was not
    measured, is not opened. The rows are written once: later readings change no order.
    """
    keys = ["session_id", "segment_id", "window_index"]
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    met = targets.alias("t").join(readings.withColumn("_there", F.lit(True)).alias("r"), same[0] & same[1] & same[2], "left")
    faults = met.where("_there IS NULL").select("t.order_id", "position", *(f"t.{k}" for k in keys))
    length = F.coalesce(F.col("end_m") - F.col("start_m"), F.lit(150.0))
    frozen = met.groupBy("t.order_id").agg(
        (F.sum(length) * 10.0).alias("area_m2"), F.max("level").alias("worst"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        F.count("*").alias("n_targets"), F.min_by("place", "position").alias("place"), F.bool_and(F.col("_there").isNotNull()).alias("_whole"),
    )
    orders = drafts.join(frozen.where("_whole").drop("_whole"), "order_id").withColumn("status", F.lit("open"))
    events = orders.select("order_id", F.col("opened_at").alias("at"), F.lit("open").alias("status"), F.lit(None).cast("string").alias("note"))
    return orders, events, faults


def evidence(targets: DataFrame, width_m: float = 10.0, default_m: float = 150.0) -> DataFrame:
    """Area, worst level and windows of each order; a length that is not known counts as default_m."""
    length = F.coalesce(F.col("end_m") - F.col("start_m"), F.lit(default_m))
    return targets.groupBy("order_id").agg((F.sum(length) * width_m).alias("area_m2"), F.max("level").alias("worst"), F.count("*").alias("windows"))


def evidence_with_centre(targets: DataFrame, width_m: float = 10.0, default_m: float = 150.0) -> DataFrame:
    """As evidence(), the length of a target's track before its window's; and the mean of the known places."""
    long = targets.withColumns({"end_m": F.coalesce("track_m", F.col("end_m") - F.col("start_m")), "start_m": F.lit(0.0)})
    centre = targets.groupBy("order_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return evidence(long, width_m, default_m).join(centre, "order_id")


def done_area(orders: DataFrame, areas: DataFrame, by: list[str], since: Column | None = None) -> DataFrame:
    """Area and number of each group's finished orders, of those created since a time if it is given."""
    done = F.col("status") == "done"
    if since is not None:
        done &= F.col("created_at").cast("timestamp") >= since
    both = orders.join(areas.select("order_id", "area_m2"), "order_id", "left")
    return both.groupBy(*by).agg(F.coalesce(F.sum(F.when(done, F.col("area_m2"))), F.lit(0.0)).alias("area_m2"), counted(done).alias("n_done"))


def weekly(orders: DataFrame, created: str, weeks: int, as_of: Column) -> DataFrame:
    """Counts of the last weeks from Monday on, with the empty ones."""
    last = F.date_trunc("week", as_of)
    frame = orders.sparkSession.range(weeks).select((last - F.make_interval(weeks=F.col("id").cast("int"))).alias("week"))
    n = orders.groupBy(F.date_trunc("week", F.col(created).cast("timestamp")).alias("week")).agg(F.count("*").alias("n"))
    return frame.join(n, "week", "left").select(F.col("week").cast("date").alias("week"), F.coalesce("n", F.lit(0)).alias("n"))


def kpis(orders: DataFrame, readings: DataFrame, as_of: Column) -> DataFrame:
    """One row: share of low readings, orders pending, and done in the last 30 days."""
    o = orders.agg(counted(F.col("status") != "done").alias("pending"), counted((F.col("status") == "done") & (F.col("created_at").cast("timestamp") >= as_of - F.expr("interval 30 days"))).alias("done_30d"))
    r = readings.agg(share(counted(F.col("level") == 1), F.count("level")).alias("low_share"), F.count("level").alias("measured"))
    return o.crossJoin(r)  # a row by a row


def route_plan(stops: DataFrame, by: str) -> DataFrame:
    """Stops in order of km, and metres from each to the one before."""
    o = Window.partitionBy(by).orderBy("km", "stop_id")
    leg = haversine_m(F.lag("lat").over(o), F.lag("lon").over(o), F.col("lat"), F.col("lon"))
    return stops.withColumns({"position": F.row_number().over(o).cast("long"), "leg_m": F.coalesce(leg, F.lit(0.0))})
