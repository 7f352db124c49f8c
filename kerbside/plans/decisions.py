"""Lists, sampling decisions and reviews as named queries, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside import shim
from kerbside.functions import levels
from kerbside.operators import lists, orientation, readings, review, sampling, telemetry
from kerbside.operators.cloud import points_of_tracks
from kerbside.plans.catalog import END, ROWS, query, source

# Lists: optional filters, pages with totals, orders


def paged(rows: str, where: str, order: str, size: int, start: int) -> str:
    """A page's SQL: its rows, the total of the filtered set and whether more follow."""
    return f", f AS (SELECT * FROM {rows} WHERE {where}) SELECT *, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > {start + size} AS has_more FROM f ORDER BY {order} LIMIT {size} OFFSET {start}"


FOLDED = "translate(lower(coalesce(place, '')), 'áàâãäéèêëíìîïóòôõöúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn')"


def page_of_readings(s, d, limit=0, offset=0, order="HEIGHT_DESC", **values) -> DataFrame:
    return lists.page(lists.where_asked(source(s, d), **values), "readings", readings.total_order(order), limit, offset)


@query(paged(f"(SELECT {ROWS} FROM readings)", "true", "height DESC NULLS LAST" + END, 25, 0))
def readings_page_nothing_asked(s, d):
    return page_of_readings(s, d, search="  ", level=7, limit=-3, offset=-1)


@query(paged(f"(SELECT {ROWS} FROM readings)", f"level = 2 AND contains({FOLDED}, 'street 3') AND captured_at >= TIMESTAMP '1995-01-01' AND captured_at < TIMESTAMP '1997-01-01'", "captured_at DESC" + END, 40, 5))
def readings_page_all_asked(s, d):
    import datetime

    return page_of_readings(s, d, 40, 5, "CAPTURED_DESC", level=2, search=" Stréet 3", since=datetime.datetime(1995, 1, 1), until=datetime.datetime(1997, 1, 1))


@query(paged(f"(SELECT {ROWS} FROM readings)", f"coalesce(level, 0) NOT IN (1, 2, 3) AND contains({FOLDED}, 'a')", "height NULLS LAST" + END, 1000, 0))
def readings_page_level0_search(s, d):
    return page_of_readings(s, d, 5000, 0, "HEIGHT_ASC", level=0, search="A")


@query(paged(f"(SELECT {ROWS} FROM readings)", "captured_at >= TIMESTAMP '1996-06-01'", "measured_at DESC NULLS LAST" + END, 25, 50))
def readings_page_since(s, d):
    import datetime

    return page_of_readings(s, d, 25, 50, "MEASURED_DESC", since=datetime.datetime(1996, 6, 1))


REFERENCED = "(SELECT order_id, team_id, status, priority, created_at, 'OS-' || strftime(created_at, '%Y%m') || '-' || lpad(CAST(order_id AS VARCHAR), 6, '0') AS reference, 'Team ' || team_id || ' ' || CASE WHEN order_id % 3 = 0 THEN 'Urgent MOWING' ELSE 'check' END AS notes, CASE WHEN order_id % 2 = 0 THEN 'north' ELSE 'SOUTH' END AS direction FROM worders)"


def referenced(s, d) -> DataFrame:
    o = shim.orders(s, d).drop("o_totalprice")
    reference = F.concat(F.lit("OS-"), F.date_format("created_at", "yyyyMM"), F.lit("-"), F.lpad(F.col("order_id").cast("string"), 6, "0"))
    notes = F.concat(F.lit("Team "), F.col("team_id").cast("string"), F.lit(" "), F.when(F.col("order_id") % 3 == 0, "Urgent MOWING").otherwise("check"))
    return o.withColumns({"reference": reference, "notes": notes, "direction": F.when(F.col("order_id") % 2 == 0, "north").otherwise("SOUTH")})


def page_of_orders(s, d, limit=0, offset=0, **values) -> DataFrame:
    return lists.page(lists.where_asked(referenced(s, d), **values), "orders", [F.desc("created_at"), F.desc("order_id")], limit, offset)


@query(paged(REFERENCED, "starts_with(reference, 'OS-1995')", "created_at DESC, order_id DESC", 50, 0))
def orders_page_reference(s, d):
    return page_of_orders(s, d, reference="OS-1995")


@query(paged(REFERENCED, "contains(lower(notes), 'mowing') AND status = 'open'", "created_at DESC, order_id DESC", 200, 10))
def orders_page_notes_status(s, d):
    return page_of_orders(s, d, 900, 10, notes="mowing", status="open", reference="")


@query(paged(REFERENCED, "lower(direction) = 'south'", "created_at DESC, order_id DESC", 50, 0))
def orders_page_direction(s, d):
    return page_of_orders(s, d, direction="South")


def page_of_sessions(s, d, order: str, **values) -> DataFrame:
    listed = shim.sessions(s, d).join(readings.tallies(source(s, d)), "session_id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("readings", "l0", "l1", "l2", "l3")})
    return lists.page(lists.where_asked(listed, **values), "sessions", lists.session_order(order))


TALLIED = "(SELECT s.session_id, device, road, started_at, coalesce(readings, 0) AS readings, coalesce(l0, 0) AS l0, coalesce(l1, 0) AS l1, coalesce(l2, 0) AS l2, coalesce(l3, 0) AS l3 FROM sessions s LEFT JOIN (SELECT session_id, count(*) AS readings, count(*) FILTER (coalesce(level, 0) NOT IN (1,2,3)) AS l0, count(*) FILTER (level = 1) AS l1, count(*) FILTER (level = 2) AS l2, count(*) FILTER (level = 3) AS l3 FROM readings GROUP BY 1) USING (session_id))"


@query(paged(TALLIED, "true", "started_at DESC NULLS LAST, session_id DESC", 50, 0))
def sessions_page_started_desc(s, d):
    return page_of_sessions(s, d, "STARTED_DESC")


@query(paged(TALLIED, "road = 'BUILDING'", "started_at NULLS LAST, session_id DESC", 50, 0))
def sessions_page_started_asc(s, d):
    return page_of_sessions(s, d, "STARTED_ASC", road="BUILDING")


@query(paged(TALLIED, "road = 'MACHINERY'", "l3 DESC, l2 DESC, started_at DESC NULLS LAST, session_id DESC", 50, 0))
def sessions_page_critical(s, d):
    return page_of_sessions(s, d, "CRITICAL_DESC", road="MACHINERY")


@query("SELECT segment_id, session_id, captured_at FROM segments WHERE state <> 'ready' ORDER BY captured_at DESC NULLS LAST, segment_id DESC LIMIT 100")
def backfill_batch(s, d):
    return lists.backfill(shim.segments(s, d), F.col("state") != "ready", "captured_at", "segment_id", 100).select("segment_id", "session_id", "captured_at")


# Validity and states

ODD_FIXES = ", odd AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN -t ELSE t END AS t, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 95.0 ELSE lat END AS lat, CASE WHEN event_id % 19 = 0 THEN 200.0 ELSE lon END AS lon, CASE WHEN event_id % 23 = 0 THEN -1.0 ELSE accuracy END AS accuracy, CASE WHEN event_id % 29 = 0 THEN -2.0 WHEN event_id % 5 = 0 THEN NULL ELSE speed END AS speed FROM fixes)"


@query(ODD_FIXES + " SELECT event_id, CASE WHEN t < 0 THEN 'clock' WHEN lat IS NULL THEN 'position' WHEN abs(lat) > 90 THEN 'latitude' WHEN abs(lon) > 180 THEN 'longitude' WHEN accuracy < 0 THEN 'accuracy' WHEN speed < 0 THEN 'speed' END AS fault FROM odd")
def fix_validity(s, d):
    odd = lambda k: F.col("event_id") % k == 0
    f = shim.fixes(s, d).withColumns({
        "t": F.when(odd(17), -F.col("t")).otherwise(F.col("t")), "lat": F.when(odd(13), None).when(odd(11), 95.0).otherwise(F.col("lat")), "lon": F.when(odd(19), 200.0).otherwise(F.col("lon")),
        "accuracy": F.when(odd(23), -1.0).otherwise(F.col("accuracy")), "speed": F.when(odd(29), -2.0).when(odd(5), None).otherwise(F.col("speed")),
    })
    return f.select("event_id", lists.fix_fault().alias("fault"))


REQUESTS = ", requests AS (SELECT order_id AS segment_id, CASE WHEN order_id % 7 = 0 THEN 'none' ELSE sha256(CAST(order_id AS VARCHAR)) END AS checksum, CAST(floor(o_totalprice / 10) AS BIGINT) - 100 AS duration_ms, order_id % 9 - 1 AS segment_index, CASE WHEN order_id % 10 = 3 THEN ' ' ELSE 'k/' || order_id END AS object_key FROM worders)"


def requests(s, d) -> DataFrame:
    k = F.col("order_id")
    return shim.orders(s, d).select(k.alias("segment_id"), F.when(k % 7 == 0, "none").otherwise(F.sha2(k.cast("string").cast("binary"), 256)).alias("checksum"), (F.floor(F.col("o_totalprice") / 10) - 100).alias("duration_ms"), (k % 9 - 1).alias("segment_index"), F.when(k % 10 == 3, " ").otherwise(F.concat(F.lit("k/"), k.cast("string"))).alias("object_key"))


@query(REQUESTS + " SELECT segment_id, CASE WHEN NOT regexp_full_match(checksum, '[0-9a-f]{64}') THEN 'checksum' WHEN duration_ms <= 0 OR duration_ms > 30000 THEN 'duration' WHEN segment_index < 0 THEN 'index' WHEN trim(object_key) = '' THEN 'key' END AS fault FROM requests")
def request_validity(s, d):
    return requests(s, d).select("segment_id", lists.request_fault().alias("fault"))


@query(REQUESTS + " SELECT segment_id, checksum AS stored_checksum, sha256(CAST(segment_id AS VARCHAR)) AS checksum FROM requests WHERE checksum <> sha256(CAST(segment_id AS VARCHAR))")
def generation_conflicts(s, d):
    r = requests(s, d)
    return lists.generation_conflicts(r.select("segment_id", "checksum"), r.select("segment_id", F.sha2(F.col("segment_id").cast("string").cast("binary"), 256).alias("checksum")), "segment_id")


STATES = ["awaiting_upload", "uploading", "queued", "validating", "failed", "ready"]
EVENTS = ["upload_started", "upload_done", "taken", "passed", "refused", "retried"]


@query(f", m AS (SELECT order_id AS segment_id, {STATES!r}[1 + order_id % 6] AS state, {EVENTS!r}[1 + order_id // 6 % 6] AS event FROM worders), t(state, event, after) AS (VALUES {', '.join(map(repr, lists.TRANSITIONS))}) SELECT segment_id, state, event, t.after IS NOT NULL AS allowed, coalesce(t.after, state) AS after FROM m LEFT JOIN t USING (state, event)")
def state_machine(s, d):
    k = F.col("order_id")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % 6 + 1).cast("int"))
    return lists.apply_events(shim.orders(s, d).select(k.alias("segment_id"), pick(STATES, k).alias("state"), pick(EVENTS, F.floor(k / 6)).alias("event")))


TARGETS = ", targets AS (SELECT l_suppkey AS order_id, CASE WHEN l_linenumber = 5 THEN -l_orderkey ELSE l_orderkey END AS segment_id, l_orderkey * 10 + l_linenumber AS asked_at FROM lineitem)"


def targets(s, d) -> DataFrame:
    k = F.col("l_orderkey")
    return shim.table(s, d, "lineitem").select(F.col("l_suppkey").alias("order_id"), F.when(F.col("l_linenumber") == 5, -k).otherwise(k).alias("segment_id"), (k * 10 + F.col("l_linenumber")).alias("asked_at"))


@query(TARGETS + " SELECT order_id, segment_id, row_number() OVER (PARTITION BY order_id ORDER BY min(asked_at)) - 1 AS place FROM targets GROUP BY 1, 2")
def targets_in_order(s, d):
    return lists.distinct_in_order(targets(s, d), ["segment_id"], "order_id", "asked_at")


@query(TARGETS + " SELECT DISTINCT order_id, t.segment_id, CASE WHEN s.segment_id IS NULL THEN 'missing' ELSE 'unmeasured' END AS fault FROM targets t LEFT JOIN segments s ON s.segment_id = t.segment_id WHERE s.segment_id IS NULL OR s.measured_at IS NULL")
def target_faults(s, d):
    return lists.target_faults(targets(s, d).select("order_id", "segment_id").distinct(), shim.segments(s, d), ["segment_id"])


@query(" SELECT session_id, sum(coalesce(cells, 0)) AS area, max(level) AS level, coalesce(array_to_string(list_sort(list(DISTINCT CASE level WHEN 3 THEN 'tractor' WHEN 2 THEN 'brush cutter' WHEN 1 THEN 'none' END) FILTER (level IS NOT NULL)), ', '), '') AS equipment FROM readings GROUP BY 1")
def order_features(s, d):
    r = source(s, d).select("session_id", F.coalesce("cells", F.lit(0)).alias("area"), "level", levels.equipment(F.col("level")).alias("equipment"))
    return lists.order_features(r, "session_id")


# Sampling

MOTION = """, span AS (SELECT session_id, (max(t) - min(t)) / 1e9 AS duration_s, min(t) AS start_t FROM moments GROUP BY 1),
sf AS (SELECT session_id, count(*) AS fixes, (max(t) - min(t)) / 1e9 AS span_s, median(accuracy) AS accuracy, max(speed) AS top FROM fixes GROUP BY 1),
ms AS (SELECT session_id, duration_s, start_t, coalesce(fixes, 0) AS fixes, span_s, accuracy, top FROM span LEFT JOIN sf USING (session_id))"""


def motion(s, d) -> DataFrame:
    m, f = shim.moments(s, d), shim.fixes(s, d)
    seconds = (F.max("t") - F.min("t")) / 1e9
    whole = m.groupBy("session_id").agg(seconds.alias("duration_s"), F.min("t").alias("start_t"))
    part = f.groupBy("session_id").agg(F.count("*").alias("fixes"), seconds.alias("span_s"), F.median("accuracy").alias("accuracy"), F.max("speed").alias("top"))
    return whole.join(part, "session_id", "left").withColumn("fixes", F.coalesce("fixes", F.lit(0)))


@query(MOTION + " SELECT event_id, t - start_t AS t FROM fixes JOIN ms USING (session_id)")
def clock_rebased(s, d):
    return sampling.rebased(shim.fixes(s, d).join(motion(s, d).select("session_id", "start_t"), "session_id")).select("event_id", "t")


DECIDES = "coalesce(fixes >= 2 AND span_s >= 0.5 * duration_s AND greatest(3, 2 * accuracy) <= 2.78 * duration_s, false)"


@query(MOTION + f" SELECT session_id, {DECIDES} AS decides, CASE WHEN fixes = 0 THEN 'time-uniform-no-telemetry' WHEN NOT {DECIDES} THEN 'time-uniform-sparse-telemetry' WHEN top > 2 THEN 'distance-groups' ELSE 'insufficient-motion' END AS strategy FROM ms")
def sampling_strategy(s, d):
    return motion(s, d).select("session_id", sampling.telemetry_decides().alias("decides"), sampling.strategy(F.col("top") > 2).alias("strategy"))


@query(", w AS (SELECT segment_id, count(*) * 12 AS frames, max(end_m) - min(start_m) AS length_m FROM windows GROUP BY 1) SELECT segment_id, frames, length_m, frames >= 64 AND length_m BETWEEN 14 AND 25 AS graded FROM w")
def graded_windows(s, d):
    w = shim.windows(s, d).groupBy("segment_id").agg((F.count("*") * 12).alias("frames"), (F.max("end_m") - F.min("start_m")).alias("length_m"))
    return w.withColumn("graded", sampling.is_graded())


STILL = ", still AS (SELECT * REPLACE (CASE WHEN session_id % 2 = 0 THEN 0.5 ELSE speed END AS speed, CASE WHEN event_id % 6 = 0 THEN -1.0 ELSE course END AS course, CASE WHEN session_id % 4 = 0 THEN -23.5 + (lat + 23.5) / 1000 ELSE lat END AS lat, CASE WHEN session_id % 4 = 0 THEN -46.6 + (lon + 46.6) / 1000 ELSE lon END AS lon) FROM fixes)"


@query(STILL + """, g AS (SELECT session_id, degrees(atan2(sum(sin(radians(course))) FILTER (speed >= 2 AND course >= 0), sum(cos(radians(course))) FILTER (speed >= 2 AND course >= 0))) AS c, arg_min({'lat': lat, 'lon': lon}, (t, event_id)) AS f, arg_max({'lat': lat, 'lon': lon}, (t, event_id)) AS l, median(accuracy) AS accuracy FROM still GROUP BY 1),
h AS (SELECT session_id, c, accuracy, radians(f.lat) AS p, radians(l.lat) AS q, radians(l.lon - f.lon) AS dl FROM g),
i AS (SELECT *, 2 * 6371000.0 * asin(least(1, sqrt(sin((q - p) / 2) * sin((q - p) / 2) + cos(p) * cos(q) * sin(dl / 2) * sin(dl / 2)))) AS m, degrees(atan2(sin(dl) * cos(q), cos(p) * sin(q) - sin(p) * cos(q) * cos(dl))) AS a FROM h),
j AS (SELECT session_id, coalesce(c, CASE WHEN m >= greatest(3 * accuracy, 25) THEN a END) AS b FROM i)
SELECT session_id, round(CASE WHEN b < 0 THEN b + 360 ELSE b END, 6) AS bearing FROM j""")
def bearing_with_fallback(s, d):
    k, e = F.col("session_id"), F.col("event_id")
    still = shim.fixes(s, d).withColumns({
        "speed": F.when(k % 2 == 0, 0.5).otherwise(F.col("speed")), "course": F.when(e % 6 == 0, -1.0).otherwise(F.col("course")),
        "lat": F.when(k % 4 == 0, F.lit(-23.5) + (F.col("lat") + 23.5) / 1000).otherwise(F.col("lat")), "lon": F.when(k % 4 == 0, F.lit(-46.6) + (F.col("lon") + 46.6) / 1000).otherwise(F.col("lon")),
    })
    return telemetry.bearing(still).select("session_id", F.round("bearing", 6).alias("bearing"))


@query("SELECT coalesce(a.session_id, b.session_id) AS session_id, coalesce(a.road, b.road) AS road, coalesce(a.direction, b.direction) AS direction FROM (SELECT session_id, CASE WHEN session_id % 3 = 0 THEN road END AS road, CASE WHEN session_id % 2 = 0 THEN 'north' END AS direction FROM sessions WHERE session_id % 5 <> 0) a FULL JOIN (SELECT session_id, 'declared' AS road, 'south' AS direction FROM sessions WHERE session_id % 7 <> 0) b ON a.session_id = b.session_id")
def route_identity(s, d):
    k = F.col("session_id")
    derived = shim.sessions(s, d).where(k % 5 != 0).select(k, F.when(k % 3 == 0, F.col("road")).alias("road"), F.when(k % 2 == 0, "north").alias("direction"))
    declared = shim.sessions(s, d).where(k % 7 != 0).select(k, F.lit("declared").alias("road"), F.lit("south").alias("direction"))
    return sampling.route_identity(derived, declared, "session_id", ["road", "direction"])


@query(MOTION + ", r AS (SELECT session_id, 1 + session_id % 60 AS fps, duration_s / 1000 AS duration_s FROM ms) SELECT session_id, least(floor(fps * duration_s), 112) AS frames, CASE WHEN duration_s > 0 THEN least(fps, least(floor(fps * duration_s), 112) / duration_s) END AS effective_fps FROM r")
def uniform_sampling_plan(s, d):
    r = motion(s, d).select("session_id", (F.col("session_id") % 60 + 1).alias("fps"), (F.col("duration_s") / 1000).alias("duration_s"))
    return r.select("session_id", *(c.cast("double").alias(n) for n, c in sampling.uniform_plan("fps", "duration_s", telemetry.MOST_FRAMES).items()))


SAMPLED = ", sampled AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS k, CASE WHEN session_id % 5 = 0 THEN sin(event_id) ELSE t / 1e12 END AS distance, CASE WHEN session_id % 3 = 0 THEN 'time-uniform-no-telemetry' ELSE 'distance-groups' END AS strategy FROM fixes)"


def sampled(s, d) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("session_id").orderBy("t", "event_id"))
    return shim.fixes(s, d).select("session_id", k.alias("k"), F.when(F.col("session_id") % 5 == 0, F.sin("event_id")).otherwise(F.col("t") / 1e12).alias("distance"), F.when(F.col("session_id") % 3 == 0, "time-uniform-no-telemetry").otherwise("distance-groups").alias("strategy"))


@query(SAMPLED + ", b AS (SELECT *, coalesce(distance < lag(distance) OVER (PARTITION BY session_id ORDER BY k), false) AS back FROM sampled) SELECT session_id, CASE WHEN NOT bool_or(back) AND first(strategy) = 'distance-groups' THEN round(arg_max(distance, k) - arg_min(distance, k), 6) END AS length_m FROM b GROUP BY 1")
def sampled_track_length(s, d):
    return sampling.sampled_length(sampled(s, d)).withColumn("length_m", F.round("length_m", 6))


@query(SAMPLED + ", b AS (SELECT session_id, distance - lag(distance) OVER (PARTITION BY session_id ORDER BY k) AS s FROM sampled) SELECT session_id, count(s) AS steps, round(min(s), 6) AS least_m, round(median(s), 6) AS median_m, round(max(s), 6) AS most_m FROM b GROUP BY 1")
def frame_baselines(s, d):
    return sampling.baselines(sampled(s, d)).withColumns({c: F.round(c, 6) for c in ("least_m", "median_m", "most_m")})


# Tracks of poses

TRACKS = ", poses AS (SELECT point_id % 40 AS track, point_id AS k, x, y, z FROM points)"


@query(TRACKS + """, v AS (SELECT track, k, """ + ", ".join(f"coalesce(lead({a}, 3) OVER w, last({a}) OVER a) - coalesce(lag({a}, 3) OVER w, first({a}) OVER a) AS {a}" for a in "xyz") + """ FROM poses WINDOW w AS (PARTITION BY track ORDER BY k), a AS (PARTITION BY track ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT track, k, """ + ", ".join(f"CASE WHEN x * x + y * y + z * z > 0 THEN round({a} / sqrt(x * x + y * y + z * z), 6) END AS d{a}" for a in "xyz") + " FROM v")
def travel_direction(s, d):
    return sampling.travel_direction(points_of_tracks(shim.points(s, d), 40), "track", "k").withColumns({f"d{a}": F.round(f"d{a}", 6) for a in "xyz"})


@query(TRACKS + """, n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY k) - 1 AS r, greatest(1, count(*) OVER (PARTITION BY track) // 24) AS stride FROM poses),
f AS (SELECT p.track, p.k AS point, n.k AS pose, (p.x - n.x) ** 2 + (p.y - n.y) ** 2 + (p.z - n.z) ** 2 AS squared FROM poses p JOIN n ON n.track = p.track AND r % stride = 0 WHERE p.k % 2 = 1)
SELECT track, point, arg_min(pose, (squared, pose)) AS pose, round(min(squared), 9) AS squared FROM f GROUP BY 1, 2""")
def nearest_strided_pose(s, d):
    p = points_of_tracks(shim.points(s, d), 40)
    odd = p.where(F.col("k") % 2 == 1).withColumnRenamed("k", "point")
    return sampling.nearest_pose(odd, p, "track", "point", "k").withColumn("squared", F.round("squared", 9))


@query(", f AS (SELECT DISTINCT cell, voxel AS i FROM votes), w AS (SELECT DISTINCT cell, frame * 9 + 4 AS wanted FROM votes) SELECT cell, wanted, arg_min(i, (abs(i - wanted), i)) AS index FROM w JOIN f USING (cell) GROUP BY 1, 2")
def closest_frame_index(s, d):
    v = shim.votes(s, d)
    return sampling.closest_by_index(v.select("cell", (F.col("frame") * 9 + 4).alias("wanted")).distinct(), v.select("cell", F.col("voxel").alias("index")), "cell")


@query(TRACKS + ", u AS (SELECT track, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM poses) WHERE n > 0), g AS (SELECT track, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM u GROUP BY 1), l AS (SELECT *, sqrt(x * x + y * y + z * z) AS m FROM g) SELECT track, n, " + ", ".join(f"round({a} / m, 6) AS g{a}" for a in "xyz") + ", round(m / n, 6) AS coherence FROM l")
def gravity_estimate(s, d):
    p = points_of_tracks(shim.points(s, d), 40).select("track", F.col("x").alias("dx"), F.col("y").alias("dy"), F.col("z").alias("dz"))
    return review.gravity(p, "track").withColumns({c: F.round(c, 6) for c in ("gx", "gy", "gz", "coherence")})


@query(TRACKS + " SELECT track, max(x) - min(x) AS span_x, max(y) - min(y) AS span_y, max(z) - min(z) AS span_z FROM poses GROUP BY 1")
def trajectory_span(s, d):
    return review.span(points_of_tracks(shim.points(s, d), 40), "track")


# Reviews

TRIALS = ", trials AS (SELECT l_suppkey AS object_id, l_orderkey * 10 + l_linenumber AS trial_id, ['accepted', 'rejected', 'failed', 'pending'][CAST(1 + l_orderkey % 4 AS INT)] AS outcome, l_quantity AS truth, l_quantity * (1 + l_tax) AS predicted, l_discount * 20 - 0.2 AS a, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax * 20 END AS b, l_quantity / 50 AS c FROM lineitem)"


def trials(s, d) -> DataFrame:
    k = F.col("l_orderkey")
    outcome = F.element_at(F.array(*map(F.lit, review.OUTCOMES)), (k % 4 + 1).cast("int"))
    return shim.table(s, d, "lineitem").select(F.col("l_suppkey").alias("object_id"), (k * 10 + F.col("l_linenumber")).alias("trial_id"), outcome.alias("outcome"), F.col("l_quantity").alias("truth"), (F.col("l_quantity") * (1 + F.col("l_tax"))).alias("predicted"), (F.col("l_discount") * 20 - 0.2).alias("a"), F.when(F.col("l_linenumber") != 3, F.col("l_tax") * 20).alias("b"), (F.col("l_quantity") / 50).alias("c"))


@query(TRIALS + " SELECT object_id, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'pending') AS pending, count(*) AS total FROM trials GROUP BY 1")
def attempt_outcomes(s, d):
    return review.outcome_counts(trials(s, d), "object_id")


@query(TRIALS + ", u AS (SELECT *, CASE WHEN a > 0 THEN a END AS pa, CASE WHEN b > 0 THEN b END AS pb FROM trials) SELECT trial_id, round(sqrt(coalesce(pa * pa, 0) + coalesce(pb * pb, 0) + c * c), 6) AS uncertainty, CASE WHEN coalesce(pa, -1) >= coalesce(pb, -1) AND coalesce(pa, -1) >= c THEN 'a' WHEN coalesce(pb, -1) >= c THEN 'b' ELSE 'c' END AS dominant FROM u")
def uncertainty_quadrature(s, d):
    u = review.quadrature("a", "b", "c")
    return trials(s, d).select("trial_id", F.round(u["uncertainty"], 6).alias("uncertainty"), u["dominant"].alias("dominant"))


@query(TRIALS + " SELECT trial_id, CASE WHEN abs(predicted - truth) <= 1.5 THEN 'agrees' ELSE 'differs' END AS verdict FROM trials")
def scale_verdict(s, d):
    return trials(s, d).withColumn("u", F.lit(1.5)).select("trial_id", review.verdict("predicted", "truth", "u").alias("verdict"))


@query(TRIALS + ", r AS (SELECT trial_id, CASE WHEN b IS NULL OR c IS NULL THEN 'unknown' WHEN b < 0.3 OR c < 0.3 THEN 'short' WHEN NOT b / c BETWEEN 0.5 AND 2 THEN 'scale' END AS reason, b / nullif(c, 0) AS scale FROM trials) SELECT trial_id, reason, CASE WHEN reason IS NULL THEN round(scale, 6) END AS scale FROM r")
def scale_anchors(s, d):
    a = review.scale_anchor("b", "c", 0.3)
    return trials(s, d).select("trial_id", a["reason"].alias("reason"), F.round(a["scale"], 6).alias("scale"))


@query(TRIALS + ", q AS (SELECT trial_id, CASE outcome WHEN 'accepted' THEN 'accept' WHEN 'rejected' THEN 'reject' ELSE outcome END AS decision, a > 0 AND c > 0.1 AND truth > 5 AS ok, CASE WHEN b > 0.5 THEN 'blurred' WHEN b > 0.2 THEN ' ' END AS note FROM trials) SELECT trial_id, CASE decision WHEN 'accept' THEN CASE WHEN NOT ok THEN 'checks' END WHEN 'reject' THEN CASE WHEN trim(coalesce(note, '')) = '' THEN 'note' END ELSE 'decision' END AS fault FROM q")
def review_decisions(s, d):
    t = trials(s, d)
    decision = F.when(F.col("outcome") == "accepted", "accept").when(F.col("outcome") == "rejected", "reject").otherwise(F.col("outcome"))
    q = t.withColumns({"decision": decision, "ground_ok": F.col("a") > 0, "top_ok": F.col("c") > 0.1, "frames_ok": F.col("truth") > 5, "note": F.when(F.col("b") > 0.5, "blurred").when(F.col("b") > 0.2, " ")})
    return q.select("trial_id", review.decision_fault().alias("fault"))


@query(", r AS (SELECT session_id, level, height, segment_id || '/' || coalesce(window_index, -1) AS name, row_number() OVER (PARTITION BY session_id ORDER BY height DESC NULLS LAST, segment_id, coalesce(window_index, -1)) AS k FROM readings) SELECT session_id, max(coalesce(level, 0)) AS worst, count(*) AS readings, coalesce(string_agg(name, ' ' ORDER BY k) FILTER (k <= 5 AND height IS NOT NULL), '') AS tallest FROM r GROUP BY 1")
def session_map(s, d):
    return review.map_entries(source(s, d), "session_id").withColumn("tallest", F.array_join("tallest", " "))


@query(" SELECT road, count(*) AS items, " + ", ".join(f"round(100.0 * count(*) FILTER (coalesce(level, 0) = {k}) / count(*), 6) AS level_{k}" for k in range(4)) + " FROM readings JOIN sessions USING (session_id) GROUP BY 1")
def level_shares(s, d):
    return review.level_shares(source(s, d).join(shim.sessions(s, d).select("session_id", "road"), "session_id"), "road")


TURNS = ", turns AS (SELECT session_id, event_id, t // 1000000 AS t, (event_id % 7 - 3) * 2.0::DOUBLE AS rx, (event_id % 11 - 5) * 1.0::DOUBLE AS ry, CASE WHEN event_id % 50 <> 0 THEN (event_id % 13 - 6) * 0.5::DOUBLE END AS rz FROM motions)"
HALF = "CASE WHEN dt > 0 AND dt <= 0.25 AND {r} IS NOT NULL AND rx + ry + rz IS NOT NULL THEN {r} * dt / 2 ELSE 0 END"


@query(
    TURNS
    + ", o AS (SELECT *, row_number() OVER w AS i, (t - lag(t) OVER w) / 1e9 AS dt FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id)), s AS (SELECT session_id, event_id, i, t, "
    + ", ".join(f"{HALF.format(r=f'r{c}')} AS h{c}" for c in "xyz")
    + " FROM o), q AS (WITH RECURSIVE r AS (SELECT session_id, 0::BIGINT AS i, 0::BIGINT AS event_id, 0::BIGINT AS t, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z, 1.0::DOUBLE AS w FROM (SELECT DISTINCT session_id FROM s) UNION ALL"
    + " SELECT session_id, i, event_id, t, x / n, y / n, z / n, w / n FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS n FROM (SELECT s.session_id, s.i, s.event_id, s.t, x + w * hx + y * hz - z * hy AS x, y + w * hy + z * hx - x * hz AS y, z + w * hz + x * hy - y * hx AS z, w - x * hx - y * hy - z * hz AS w FROM r JOIN s ON s.session_id = r.session_id AND s.i = r.i + 1))) SELECT * FROM r WHERE i > 0)"
    + " SELECT session_id, event_id, t, round(x, 6) AS qx, round(y, 6) AS qy, round(z, 6) AS qz, round(w, 6) AS qw FROM q"
)
def orientation_scan(s, d):
    """Times are shortened so that days pass as gaps of a sensor."""
    e = F.col("event_id")
    turns = shim.motions(s, d).select("session_id", "event_id", F.expr("t div 1000000").alias("t"), ((e % 7 - 3) * 2.0).alias("rx"), ((e % 11 - 5) * 1.0).alias("ry"), F.when(e % 50 != 0, (e % 13 - 6) * 0.5).alias("rz"))
    return orientation.orientations(turns, "session_id", "event_id").select("session_id", "event_id", "t", *(F.round(c, 6).alias(c) for c in orientation.PARTS))
