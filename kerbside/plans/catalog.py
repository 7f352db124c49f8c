"""The library's operators as named queries over the test tables, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside import shim
from kerbside.functions import geo, levels, stats, text
from kerbside.operators import asof, cells, changes, cloud, documents, places, readings, routes, telemetry, work

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with what follows the common table expressions of its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = shim.PROLOGUE + sql
        return f

    return register


def source(s: SparkSession, d: str) -> DataFrame:
    return readings.reading_source(shim.segments(s, d), shim.windows(s, d))


TALLY = "count(*) AS readings, count(*) FILTER (coalesce(level, 0) NOT IN (1,2,3)) AS l0, count(*) FILTER (level = 1) AS l1, count(*) FILTER (level = 2) AS l2, count(*) FILTER (level = 3) AS l3"
ROWS = "session_id, segment_id, window_index, captured_at, height, cells, level, quality, place, measured_at, start_m, end_m"
END = ", session_id, segment_id, coalesce(window_index, -1)"
SUMMARY = "count(*) AS total, count(*) FILTER (coalesce(level, 0) NOT IN (1,2,3)) AS level_0, count(*) FILTER (level = 1) AS level_1, count(*) FILTER (level = 2) AS level_2, count(*) FILTER (level = 3) AS level_3, max(height) AS tallest, count(*) FILTER (quality = 'good') AS good, count(*) FILTER (quality = 'degraded') AS degraded, count(*) FILTER (coalesce(quality, '') NOT IN ('good', 'degraded')) AS other, sum(end_m - start_m) AS measured_metres, count(*) FILTER (start_m IS NOT NULL AND end_m IS NOT NULL) AS ranged"


@query(f"""
, t AS (SELECT session_id, {TALLY} FROM readings GROUP BY 1),
p AS (SELECT session_id, arg_min(place, (segment_id, coalesce(window_index, -1))) AS place, count(DISTINCT place) AS places FROM readings WHERE place IS NOT NULL GROUP BY 1)
SELECT s.session_id, device, road, started_at, coalesce(readings, 0) AS readings, coalesce(l0, 0) AS l0, coalesce(l1, 0) AS l1, coalesce(l2, 0) AS l2, coalesce(l3, 0) AS l3, place, coalesce(places, 0) AS places
FROM sessions s LEFT JOIN t USING (session_id) LEFT JOIN p USING (session_id) ORDER BY l3 DESC, l2 DESC, started_at DESC NULLS LAST, s.session_id DESC LIMIT 50""")
def session_list(s, d):
    return readings.session_list(shim.sessions(s, d), source(s, d))


@query(f"SELECT {ROWS} FROM readings")
def reading_source(s, d):
    return source(s, d)


@query(f"SELECT {ROWS} FROM readings ORDER BY height DESC NULLS LAST{END} LIMIT 25")
def readings_page_height_desc(s, d):
    return readings.page(source(s, d), "HEIGHT_DESC")


@query(f"SELECT {ROWS} FROM readings ORDER BY height ASC NULLS LAST{END} LIMIT 25 OFFSET 50")
def readings_page_height_asc(s, d):
    return readings.page(source(s, d), "HEIGHT_ASC", 25, 50)


@query(f"SELECT {ROWS} FROM readings ORDER BY captured_at{END} LIMIT 100")
def readings_page_captured_asc(s, d):
    return readings.page(source(s, d), "CAPTURED_ASC", 100)


@query(f"SELECT {ROWS} FROM readings ORDER BY measured_at DESC NULLS LAST{END} LIMIT 100")
def readings_page_measured_desc(s, d):
    return readings.page(source(s, d), "MEASURED_DESC", 100)


@query(f"SELECT {SUMMARY} FROM readings")
def readings_summary(s, d):
    return readings.summary(source(s, d))


@query(f"SELECT {SUMMARY} FROM readings WHERE session_id < 0")
def readings_summary_of_nothing(s, d):
    return readings.summary(source(s, d).where("session_id < 0"))


@query(f"SELECT {ROWS} FROM readings WHERE level IS NULL OR level NOT IN (1, 2, 3)")
def readings_level0(s, d):
    return source(s, d).where(levels.has_level(F.col("level"), 0))


@query(f"SELECT {ROWS} FROM readings WHERE captured_at >= TIMESTAMP '1996-01-01' AND captured_at < TIMESTAMP '1997-01-01' AND level = 3")
def readings_half_open_range(s, d):
    at = F.col("captured_at")
    return source(s, d).where((at >= F.lit("1996-01-01").cast("timestamp_ntz")) & (at < F.lit("1997-01-01").cast("timestamp_ntz")) & levels.has_level(F.col("level"), 3))


@query(f"SELECT {ROWS} FROM readings WHERE contains(lower(coalesce(place, '')), 'ring')")
def readings_search_folded(s, d):
    return source(s, d).where(text.contains_folded("RÍNG", F.col("place")))


@query("SELECT doc_id, contains(translate(lower(coalesce(text, '')), 'áàâãäéèêëíìîïóòôõöúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn'), 'cion de') AS hit FROM documents")
def documents_search_folded(s, d):
    return shim.table(s, d, "documents").select("doc_id", text.contains_folded("ción de", F.col("text")).alias("hit"))


@query(f"SELECT session_id, {TALLY} FROM readings GROUP BY 1")
def session_tallies(s, d):
    return readings.tallies(source(s, d))


@query("SELECT session_id, arg_min(place, (segment_id, coalesce(window_index, -1))) AS place, count(DISTINCT place) AS places FROM readings WHERE place IS NOT NULL GROUP BY 1")
def session_place(s, d):
    return readings.first_place_ranked(source(s, d))


@query("SELECT * FROM segments s WHERE EXISTS (SELECT 1 FROM windows w WHERE w.segment_id = s.segment_id)")
def segments_with_windows_semi(s, d):
    return shim.segments(s, d).join(shim.windows(s, d), "segment_id", "left_semi")


@query("SELECT * FROM segments s WHERE NOT EXISTS (SELECT 1 FROM windows w WHERE w.segment_id = s.segment_id)")
def segments_without_windows_anti(s, d):
    return shim.segments(s, d).join(shim.windows(s, d), "segment_id", "left_anti")


@query("SELECT s.session_id, segment_id, state, (SELECT count(*) FROM windows w WHERE w.segment_id = s.segment_id) AS n_windows, (SELECT count(*) FROM windows w WHERE w.segment_id = s.segment_id AND level IS NOT NULL) AS n_measured FROM segments s")
def segment_window_counts(s, d):
    out = readings.with_child_counts(shim.segments(s, d), shim.windows(s, d), "segment_id", n_windows=F.lit(True), n_measured=F.col("level").isNotNull())
    return out.select("session_id", "segment_id", "state", "n_windows", "n_measured")


@query("SELECT session_id, count(segment_id) AS segments, count(*) FILTER (state = 'ready') AS ready, count(level) AS measured, count(*) FILTER (state = 'ready') = count(segment_id) AND count(segment_id) > 0 AS complete FROM sessions LEFT JOIN segments USING (session_id) GROUP BY 1")
def session_ready_state(s, d):
    seg = shim.segments(s, d)
    out = readings.with_child_counts(shim.sessions(s, d).select("session_id"), seg, "session_id", segments=F.lit(True), ready=F.col("state") == "ready", measured=F.col("level").isNotNull())
    return out.withColumn("complete", (F.col("segments") > 0) & (F.col("ready") == F.col("segments")))


@query(""", r AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY (level IS NOT NULL)::INT DESC, coalesce(level, 0) DESC, coalesce(height, -1) DESC, window_index) AS k FROM windows)
SELECT segment_id, level, height, window_index, m AS measured_at, c AS cells FROM r JOIN (SELECT segment_id, max(measured_at) AS m, CAST(sum(cells) AS BIGINT) AS c FROM windows GROUP BY 1) USING (segment_id) WHERE k = 1""")
def window_rollup_worst(s, d):
    return readings.window_rollup(shim.windows(s, d))


@query("SELECT team_id, count(*) FILTER (status = 'open') AS n_open, count(*) FILTER (status = 'scheduled') AS n_scheduled, count(*) FILTER (status = 'done') AS n_done FROM (SELECT s_suppkey AS team_id FROM supplier) LEFT JOIN worders USING (team_id) GROUP BY 1")
def team_workload_pivot(s, d):
    return work.team_workload(shim.table(s, d, "supplier").select(F.col("s_suppkey").alias("team_id")), shim.orders(s, d))


@query("SELECT team_id, status, count(*) AS n FROM worders GROUP BY 1, 2")
def orders_by_team_status(s, d):
    return shim.orders(s, d).groupBy("team_id", "status").agg(F.count("*").alias("n"))


@query(""", top AS (SELECT * FROM worders ORDER BY created_at DESC, order_id DESC LIMIT 50)
SELECT order_id, status, created_at, coalesce(string_agg(window_index || ':' || coalesce(level, 0), ',' ORDER BY window_index), '') AS targets FROM top LEFT JOIN windows ON segment_id = order_id GROUP BY 1, 2, 3""")
def orders_page_nested(s, d):
    targets = shim.windows(s, d).select(F.col("segment_id").alias("order_id"), F.col("window_index").alias("position"), F.coalesce("level", F.lit(0)).alias("window_level"))
    page = work.nested_page(shim.orders(s, d), targets, 50)
    return page.select("order_id", "status", "created_at", F.array_join(F.transform("targets", lambda t: F.concat_ws(":", t["position"].cast("string"), t["window_level"].cast("string"))), ",").alias("targets"))


@query("SELECT segment_id AS order_id, sum(coalesce(end_m - start_m, 150.0)) * 10 AS area_m2, max(level) AS worst, count(*) AS windows FROM windows GROUP BY 1")
def order_evidence_area(s, d):
    return work.evidence(shim.windows(s, d).withColumnRenamed("segment_id", "order_id"))


@query("SELECT order_id, 'WO-' || strftime(created_at, '%Y%m') || '-' || CAST(1000 + row_number() OVER (PARTITION BY strftime(created_at, '%Y%m') ORDER BY created_at, order_id) AS VARCHAR) AS reference FROM worders")
def order_reference_sequence(s, d):
    return changes.monthly_reference(shim.orders(s, d), "created_at", "order_id", "WO").select("order_id", "reference")


@query(""", weeks AS (SELECT date_trunc('week', TIMESTAMP '2001-06-06') - to_days(CAST(7 * i AS INT)) AS week FROM range(12) r(i)), n AS (SELECT date_trunc('week', created_at) AS week, count(*) AS n FROM worders GROUP BY 1)
SELECT CAST(week AS DATE) AS week, coalesce(n, 0) AS n FROM weeks LEFT JOIN n USING (week)""")
def weekly_buckets_zero_filled(s, d):
    return work.weekly(shim.orders(s, d), "created_at", 12, F.lit("2001-06-06").cast("timestamp"))


@query(", o AS (SELECT count(*) FILTER (status <> 'done') AS pending, count(*) FILTER (status = 'done' AND created_at >= TIMESTAMP '2000-06-01' - INTERVAL 30 DAY) AS done_30d FROM worders), r AS (SELECT count(*) FILTER (level = 1) / count(level)::DOUBLE AS low_share, count(level) AS measured FROM readings) SELECT * FROM o, r")
def kpi_block(s, d):
    return work.kpis(shim.orders(s, d), source(s, d), F.lit("2000-06-01").cast("timestamp"))


@query("SELECT segment_id, window_index, height FROM windows WHERE level = 3 ORDER BY height DESC, segment_id, window_index LIMIT 5")
def critical_top5(s, d):
    return shim.windows(s, d).where("level = 3").orderBy(F.desc("height"), "segment_id", "window_index").limit(5).select("segment_id", "window_index", "height")


@query(", old AS (SELECT segment_id, window_index, height FROM windows), new AS (SELECT segment_id, window_index, height + 1 AS height FROM windows WHERE segment_id % 3 = 0 UNION ALL SELECT segment_id, 99, 1.0 FROM segments WHERE segment_id % 5 = 0) SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.segment_id = old.segment_id AND new.window_index = old.window_index) UNION ALL SELECT * FROM new")
def upsert_windows(s, d):
    old = shim.windows(s, d).select("segment_id", "window_index", "height")
    new = old.where("segment_id % 3 = 0").withColumn("height", F.col("height") + 1).unionByName(shim.segments(s, d).where("segment_id % 5 = 0").select("segment_id", F.lit(99).alias("window_index"), F.lit(1.0).alias("height")))
    return changes.upsert(old, new, ["segment_id", "window_index"])


@query(", old AS (SELECT segment_id, window_index, height FROM windows) SELECT * FROM old WHERE segment_id % 4 <> 0 UNION ALL SELECT segment_id, 0, height * 2 FROM old WHERE segment_id % 4 = 0 AND window_index = 0")
def replace_segment_windows(s, d):
    old = shim.windows(s, d).select("segment_id", "window_index", "height")
    return changes.replace_groups(old, old.where("segment_id % 4 = 0 AND window_index = 0").withColumn("height", F.col("height") * 2), ["segment_id"])


@query(", h AS (SELECT team_id, order_id, status, lag(status) OVER (PARTITION BY team_id ORDER BY order_id) AS from_status FROM worders) SELECT * FROM h WHERE from_status IS DISTINCT FROM status")
def status_events_on_change(s, d):
    return changes.status_events(shim.orders(s, d).select("team_id", "order_id", "status"), "team_id", "order_id", "status")


@query("SELECT team_id, arg_max(status, order_id) AS status, count(*) AS events FROM worders GROUP BY 1")
def current_state(s, d):
    return changes.current_state(shim.orders(s, d), "team_id", "order_id", "status")


@query("SELECT order_id, status, CASE WHEN status = 'open' AND priority <= 2 THEN 'scheduled' ELSE status END AS next, coalesce(status = 'open' AND priority <= 2, false) AS changed FROM worders")
def guarded_update(s, d):
    o = shim.orders(s, d).select("order_id", "status", "priority", F.col("status").alias("next"))
    return changes.guarded(o, (F.col("status") == "open") & (F.col("priority") <= 2), next=F.lit("scheduled")).select("order_id", "status", "next", "changed")


@query("SELECT session_id, device, road FROM sessions WHERE started_at IS NULL OR started_at >= TIMESTAMP '1996-01-01'")
def expiry_delete(s, d):
    return changes.expired(shim.sessions(s, d), "started_at", F.lit("1996-01-01").cast("timestamp_ntz")).select("session_id", "device", "road")


@query(", m AS (SELECT quantile_disc(height, 0.95) AS p95, max(height) AS tallest, count(height) AS n, segment_id FROM windows WHERE height IS NOT NULL GROUP BY segment_id) SELECT segment_id, p95, tallest, n, CASE WHEN n < 2 THEN NULL WHEN p95 > 0.3 THEN 3 WHEN p95 >= 0.1 THEN 2 ELSE 1 END AS level FROM m")
def stretch_p95_level(s, d):
    w = shim.windows(s, d).where("height IS NOT NULL").groupBy("segment_id").agg(stats.nearest_rank("height", 0.95).alias("p95"), F.max("height").alias("tallest"), F.count("height").alias("n"))
    return w.withColumn("level", levels.level(F.col("p95"), F.when(F.col("n") >= 2, levels.LEAST_CELLS).otherwise(0)))


ROOT = "sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))"
HAVERSINE = f"2 * 6371000.0 * asin({ROOT} - greatest(0, {ROOT} - 1))"  # null for a null


@query(", k AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM fixes WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id)) SELECT session_id, avg(lat) AS lat, avg(lon) AS lon, count(*) FILTER (plat IS NULL OR plat <> lat OR plon <> lon) AS vertices FROM k GROUP BY 1")
def track_summary(s, d):
    return documents.track(shim.fixes(s, d).withColumn("o", F.struct("t", "event_id")), "session_id", "o").select("session_id", "lat", "lon", "vertices")


@query(", k AS (SELECT session_id, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM fixes WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id)) SELECT session_id, sum(" + HAVERSINE.format(a="p", b="") + ") AS metres FROM k GROUP BY 1")
def track_length_haversine(s, d):
    o = telemetry.ordered("event_id")
    step = geo.haversine_m(F.lag("lat").over(o), F.lag("lon").over(o), F.col("lat"), F.col("lon"))
    return shim.fixes(s, d).select("session_id", step.alias("m")).groupBy("session_id").agg(F.sum("m").alias("metres"))


def nearest_fix(s, d):
    return asof.nearest(shim.motions(s, d).select("session_id", "event_id", "t"), shim.fixes(s, d).select("session_id", "t", F.col("event_id").alias("fix_id"), "speed", "accuracy"), ["session_id"], "t", ["fix_id", "speed", "accuracy"], "fix_id", 3_600_000_000_000)


@query(""", f1 AS (SELECT session_id, t, min(event_id) AS fix_id FROM fixes GROUP BY 1, 2),
n AS (SELECT m.session_id, m.event_id, f1.fix_id, abs(m.t - f1.t) AS age, row_number() OVER (PARTITION BY m.event_id ORDER BY abs(m.t - f1.t), f1.t) AS k FROM motions m LEFT JOIN f1 USING (session_id))
SELECT session_id, event_id, CASE WHEN age <= 3600000000000 THEN fix_id END AS fix_id, age FROM n WHERE k = 1""")
def asof_nearest_tolerance(s, d):
    return nearest_fix(s, d).select("session_id", "event_id", "fix_id", "age")


@query("SELECT event_id, session_id, t FROM (SELECT *, max(t) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM fixes) WHERE m IS NULL OR t >= m")
def running_max_filter(s, d):
    return telemetry.usable(shim.fixes(s, d)).select("event_id", "session_id", "t")


DISTANCE = ", g AS (SELECT *, coalesce((t - lag(t) OVER w) / 1e9 * (speed + lag(speed) OVER w) / 2, 0) AS step FROM fixes WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id)), profile AS (SELECT *, sum(step) OVER (PARTITION BY session_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS distance FROM g)"


@query(DISTANCE + " SELECT session_id, event_id, round(distance, 3) AS distance FROM profile")
def cumulative_distance(s, d):
    return telemetry.with_distance(shim.fixes(s, d)).select("session_id", "event_id", F.round("distance", 3).alias("distance"))


@query(DISTANCE + """, lo AS (SELECT m.event_id, max(p.t) AS bt FROM motions m JOIN profile p ON p.session_id = m.session_id AND p.t <= m.t GROUP BY 1), hi AS (SELECT m.event_id, min(p.t) AS nt FROM motions m JOIN profile p ON p.session_id = m.session_id AND p.t >= m.t GROUP BY 1),
u AS (SELECT session_id, t, max(distance) AS distance FROM profile GROUP BY 1, 2)
SELECT m.session_id, m.event_id AS frame_id, round(CASE WHEN nt IS NULL THEN b.distance WHEN bt IS NULL THEN a.distance WHEN nt <= bt THEN b.distance ELSE b.distance + (m.t - bt)::DOUBLE / (nt - bt) * (a.distance - b.distance) END, 3) AS distance
FROM motions m LEFT JOIN lo USING (event_id) LEFT JOIN hi USING (event_id) LEFT JOIN u b ON b.session_id = m.session_id AND b.t = bt LEFT JOIN u a ON a.session_id = m.session_id AND a.t = nt WHERE bt IS NOT NULL OR nt IS NOT NULL""")
def interpolate_distance(s, d):
    frames = shim.motions(s, d).select("session_id", "t", F.col("event_id").alias("frame_id"))
    out = telemetry.distance_at(frames, telemetry.with_distance(shim.fixes(s, d)))
    return out.where("distance IS NOT NULL").select("session_id", "frame_id", F.round("distance", 3).alias("distance"))


@query(DISTANCE + ", m AS (SELECT session_id, max(distance) AS path, median(accuracy) AS accuracy, count(*) AS fixes, max(speed) AS top FROM profile GROUP BY 1) SELECT session_id, round(path, 3) AS path, accuracy, fixes, path >= 3 AS moved FROM m WHERE top > 0.01")
def motion_gate(s, d):
    m = telemetry.motion_summary(telemetry.with_distance(shim.fixes(s, d)))
    return m.select("session_id", F.round("path", 3).alias("path"), "accuracy", "fixes", "moved")


def drive(s, d):
    """Frames of short drives: each session's motions as frames a metre or so apart."""
    return shim.motions(s, d).select("session_id", F.col("event_id").alias("frame_id"), (F.row_number().over(telemetry.ordered("event_id")) * 1.5).alias("distance"))


DRIVE = ", drive AS (SELECT session_id, event_id AS frame_id, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) * 1.5::DOUBLE AS distance FROM motions)"


@query(DRIVE + ", s AS (SELECT session_id, min(distance) AS d0, max(distance) AS d1, greatest(1, least(ceil((max(distance) - min(distance)) / 25.0 - 1e-9), floor(count(*) / 8.0)))::INT AS n FROM drive GROUP BY 1), w AS (SELECT *, (d1 - d0) / n AS size, unnest(range(0, n)) AS w FROM s) SELECT w.session_id, w, count(*) AS frames, min(distance) AS start_m, max(distance) AS end_m FROM w JOIN drive f ON f.session_id = w.session_id AND distance >= d0 + w * size AND distance <= d0 + (w + 1) * size GROUP BY 1, 2 HAVING count(*) >= 2")
def distance_windows(s, d):
    return telemetry.distance_windows(drive(s, d), least=8)


WINDOWS = DRIVE + ", s AS (SELECT session_id, min(distance) AS d0, max(distance) AS d1, greatest(1, least(ceil((max(distance) - min(distance)) / 25.0 - 1e-9), floor(count(*) / 8.0)))::INT AS n FROM drive GROUP BY 1), w AS (SELECT *, (d1 - d0) / n AS size, unnest(range(0, n)) AS w FROM s), dw AS (SELECT w.session_id, w, count(*) AS frames FROM w JOIN drive f ON f.session_id = w.session_id AND distance >= d0 + w * size AND distance <= d0 + (w + 1) * size GROUP BY 1, 2 HAVING count(*) >= 2)"


@query(WINDOWS + ", o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY w) AS i FROM dw), p AS (WITH RECURSIVE r AS (SELECT session_id, w, i, frames AS held, 0 AS pack FROM o WHERE i = 1 UNION ALL SELECT o.session_id, o.w, o.i, CASE WHEN held + o.frames <= 24 THEN held + o.frames ELSE o.frames END, CASE WHEN held + o.frames <= 24 THEN pack ELSE pack + 1 END FROM r JOIN o ON o.session_id = r.session_id AND o.i = r.i + 1) SELECT * FROM r) SELECT session_id, w, pack FROM p")
def greedy_window_packing(s, d):
    return telemetry.pack(telemetry.distance_windows(drive(s, d), least=8), ["session_id"], "w", "frames", 24)


@query("SELECT session_id, round(CASE WHEN b < 0 THEN b + 360 ELSE b END, 6) AS bearing FROM (SELECT session_id, degrees(atan2(sum(sin(radians(course))), sum(cos(radians(course))))) AS b FROM fixes WHERE speed >= 2 GROUP BY 1)")
def circular_bearing(s, d):
    return telemetry.bearing(shim.fixes(s, d).where(f"speed >= {telemetry.COURSE_SPEED}")).select("session_id", F.round("bearing", 6).alias("bearing"))


@query(", c AS (SELECT event_id, marker, km, " + HAVERSINE.format(a="", b="m") + " AS dist FROM fixes, markers), b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, km) AS k FROM c WHERE dist <= 500) SELECT f.event_id, marker, km, round(dist, 6) AS distance FROM fixes f LEFT JOIN b ON b.event_id = f.event_id AND k = 1")
def nearest_marker(s, d):
    out = places.nearest_marker(shim.fixes(s, d), shim.markers(s, d), "event_id", 500.0)
    return out.select("event_id", "marker", "km", F.round("distance", 6).alias("distance"))


LOCAL = "(({p}lon - f.lon) * 111320.0 * cos(radians(f.lat)))", "(({p}lat - f.lat) * 111320.0)"
PIECE = {f"{p}{axis}": LOCAL[k].format(p=p) for p in "ab" for k, axis in enumerate("xy")}
ALONG = "greatest(0, least(1, (-{ax} * ({bx} - {ax}) - {ay} * ({by} - {ay})) / nullif(({bx} - {ax}) ** 2 + ({by} - {ay}) ** 2, 0)))".format(**PIECE)


@query(", v AS (SELECT 'R' || km % 3 AS road, km, mlat + km % 3 * 0.001::DOUBLE AS lat, mlon AS lon FROM markers), p AS (SELECT road, km AS ord, lat AS alat, lon AS alon, lead(lat) OVER o AS blat, lead(lon) OVER o AS blon FROM v WINDOW o AS (PARTITION BY road ORDER BY km)), c AS (SELECT event_id, road, ord, " + ", ".join(f"{v} AS {k}_" for k, v in PIECE.items()) + f", coalesce({ALONG}, 0) AS t FROM fixes f, p WHERE blat IS NOT NULL), g AS (SELECT *, sqrt((ax_ + t * (bx_ - ax_)) ** 2 + (ay_ + t * (by_ - ay_)) ** 2) AS m FROM c), n AS (SELECT event_id, arg_min(road, (round(m, 6), road)) AS road, min(m) AS m FROM g WHERE m <= 400 GROUP BY 1) SELECT f.event_id, road, round(round(m, 6), 3) AS distance FROM fixes f LEFT JOIN n ON n.event_id = f.event_id")
def map_match_polyline(s, d):
    roads = shim.markers(s, d).select(F.concat(F.lit("R"), (F.col("km") % 3).cast("string")).alias("road"), F.col("km").alias("ord"), (F.col("mlat") + F.col("km") % 3 * 0.001).alias("lat"), F.col("mlon").alias("lon"))
    return places.match_road(shim.fixes(s, d).select("event_id", "lat", "lon"), roads, "event_id").select("event_id", "road", F.round("distance", 3).alias("distance"))


STOPS = ", stops AS (SELECT c_custkey AS stop_id, c_mktsegment AS road, c_custkey * 37 % 400 / 10.0::DOUBLE AS km, -23.5::DOUBLE + c_custkey * 37 % 400 * 0.0009::DOUBLE AS lat, -46.6::DOUBLE + c_custkey % 7 * 0.0005::DOUBLE AS lon FROM customer)"


def stops(s, d):
    km = F.col("c_custkey") * 37 % 400
    return shim.table(s, d, "customer").select(F.col("c_custkey").alias("stop_id"), F.col("c_mktsegment").alias("road"), (km / F.lit(10.0)).alias("km"), (F.lit(-23.5) + km * 0.0009).alias("lat"), (F.lit(-46.6) + F.col("c_custkey") % 7 * 0.0005).alias("lon"))


@query(STOPS + ", p AS (SELECT a.stop_id AS a, b.stop_id AS b, " + HAVERSINE.format(a="a.", b="b.") + " AS distance FROM stops a JOIN stops b ON a.stop_id < b.stop_id AND abs(a.km - b.km) <= 4.5) SELECT a, b, round(distance, 6) AS distance FROM p WHERE distance <= 1500")
def neighbour_pairs(s, d):
    return places.neighbour_pairs(stops(s, d), "stop_id", digits=6)


@query(STOPS + ", o AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, row_number() OVER w AS position FROM stops WINDOW w AS (PARTITION BY road ORDER BY km, stop_id)) SELECT road, stop_id, position, round(coalesce(" + HAVERSINE.format(a="p", b="") + ", 0), 6) AS leg_m FROM o")
def route_plan_km(s, d):
    return work.route_plan(stops(s, d), "road").select("road", "stop_id", "position", F.round("leg_m", 6).alias("leg_m"))


FEATURES = STOPS + ", used AS (SELECT c_custkey AS stop_id FROM customer WHERE c_custkey % 11 = 0), feats AS (SELECT s.*, stop_id % 4 AS level, abs(c_acctbal) AS area_m2, 'kit ' || c_nationkey % 3 AS equipment FROM stops s JOIN customer ON c_custkey = stop_id), cand AS (SELECT *, row_number() OVER (PARTITION BY road ORDER BY km, stop_id) AS i FROM feats WHERE level >= 2 AND stop_id NOT IN (SELECT stop_id FROM used))"
GROUPS = FEATURES + ", near AS (SELECT a.road, a.i, b.i AS j, " + HAVERSINE.format(a="a.", b="b.") + " / 1000 AS d FROM cand a JOIN cand b ON a.road = b.road AND b.i > a.i AND b.km - a.km <= 4.5), nb AS (SELECT c.road, c.i, list(n.j ORDER BY n.j) FILTER (n.j IS NOT NULL) AS js FROM cand c LEFT JOIN near n ON n.road = c.road AND n.i = c.i AND n.d <= 1.5 GROUP BY 1, 2), steps AS (WITH RECURSIVE r AS (SELECT road, 0::BIGINT AS i, []::BIGINT[] AS taken, []::BIGINT[] AS got FROM (SELECT DISTINCT road FROM cand) UNION ALL SELECT road, n.i, list_concat(taken, n.got), n.got FROM (SELECT r.road, nb.i, taken, CASE WHEN list_contains(taken, nb.i) THEN []::BIGINT[] ELSE list_filter(coalesce(js, []::BIGINT[]), lambda x: NOT list_contains(taken, x))[1:2] END AS got FROM r JOIN nb ON nb.road = r.road AND nb.i = r.i + 1) n) SELECT * FROM r WHERE len(got) > 0), mem AS (SELECT road, i, 0 AS place, i AS j FROM steps UNION ALL SELECT road, i, unnest(range(1, len(got) + 1)), unnest(got) FROM steps), members AS (SELECT m.road, a.stop_id AS anchor, m.place, c.stop_id, CASE WHEN m.place = 0 THEN 0 ELSE n.d END AS between_km FROM mem m JOIN cand a ON a.road = m.road AND a.i = m.i JOIN cand c ON c.road = m.road AND c.i = m.j LEFT JOIN near n ON n.road = m.road AND n.i = m.i AND n.j = m.j)"


def features(s, d):
    c = shim.table(s, d, "customer").select(F.col("c_custkey").alias("stop_id"), (F.col("c_custkey") % 4).alias("level"), F.abs("c_acctbal").alias("area_m2"), F.concat(F.lit("kit "), (F.col("c_nationkey") % 3).cast("string")).alias("equipment"))
    return stops(s, d).join(c, "stop_id")


def grouped_stops(s, d):
    used = shim.table(s, d, "customer").where("c_custkey % 11 = 0").select(F.col("c_custkey").alias("stop_id"))
    return routes.groups(routes.candidates(features(s, d), used), "road")


@query(GROUPS + " SELECT road, anchor, place, stop_id, round(between_km, 6) AS between_km FROM members")
def greedy_route_groups(s, d):
    return grouped_stops(s, d).withColumn("between_km", F.round("between_km", 6))


@query(GROUPS + " SELECT m.road, anchor, string_agg(m.stop_id::VARCHAR, ' ' ORDER BY place) AS stops, max(level) AS level, round(sum(area_m2), 4) AS area_m2, round(max(between_km), 6) AS between_km, max(CASE WHEN place = 0 THEN km END) AS km, count(DISTINCT equipment) = 1 AS same_equipment FROM members m JOIN feats f USING (road, stop_id) GROUP BY 1, 2")
def trip_suggestions(s, d):
    out = routes.suggestions(grouped_stops(s, d), features(s, d), "road")
    return out.withColumns({"stops": F.array_join(F.transform("stops", lambda x: x.cast("string")), " "), "area_m2": F.round("area_m2", 4), "between_km": F.round("between_km", 6)})


@query(", c AS (SELECT event_id, marker, km, round(" + HAVERSINE.format(a="", b="m") + ", 6) AS dist FROM fixes, markers) SELECT event_id, arg_min(marker, (dist, km, marker)) AS marker, arg_min(km, (dist, km, marker)) AS km, round(min(dist), 3) AS distance FROM c GROUP BY 1")
def nearest_km(s, d):
    return places.nearest_of_all(shim.fixes(s, d), shim.markers(s, d)).select("event_id", "marker", "km", F.round("distance", 3).alias("distance"))


VOTES = ", vox AS (SELECT cell, frame, voxel, min(height) AS height FROM votes GROUP BY 1, 2, 3), rk AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY cell, frame) AS n, lead(height) OVER w - height AS gap FROM vox WINDOW w AS (PARTITION BY cell, frame ORDER BY height, voxel)), fv AS (SELECT cell, frame, count(*) AS voxels, quantile_disc(height, 0.5) AS h50, quantile_disc(height, 0.9) AS h90, quantile_disc(height, 0.95) AS h95, quantile_disc(height, 0.02) AS ground, max(gap) FILTER (r <= n - ceil(n * 0.1)) AS gap FROM rk GROUP BY 1, 2 HAVING count(*) >= 20)"


def votes(s, d):
    return cells.frame_votes(cells.voxel_minima(shim.votes(s, d)))


@query(VOTES + " SELECT * FROM vox")
def voxel_min_votes(s, d):
    return cells.voxel_minima(shim.votes(s, d))


@query(VOTES + " SELECT * FROM fv")
def frame_vote_percentiles(s, d):
    return votes(s, d)


@query(VOTES + ", g AS (SELECT cell, count(*) AS votes, quantile_disc(h50, 0.5) AS h50, quantile_disc(h90, 0.5) AS h90, quantile_disc(h95, 0.5) AS h95, max(h95) - min(h95) AS spread, CAST(sum(voxels) AS BIGINT) AS samples FROM fv GROUP BY 1) SELECT cell, votes, CASE WHEN votes >= 3 THEN h50 END AS h50, CASE WHEN votes >= 3 THEN h90 END AS h90, CASE WHEN votes >= 3 THEN h95 END AS h95, CASE WHEN votes >= 3 THEN spread END AS spread, samples, CASE WHEN votes < 3 THEN 'too few votes' END AS reason FROM g")
def cell_reduce_medians(s, d):
    return cells.cell_heights(votes(s, d))


@query(VOTES + ", pool AS (SELECT cell, voxel, min(height) AS height FROM vox SEMI JOIN fv USING (cell, frame) GROUP BY 1, 2), g AS (SELECT cell, quantile_disc(height, 0.02) AS ground FROM pool GROUP BY 1) SELECT cell, ground, count(*) FILTER (height <= ground + 0.05) AS contacts FROM pool JOIN g USING (cell) GROUP BY 1, 2")
def pooled_ground(s, d):
    v = cells.voxel_minima(shim.votes(s, d))
    return cells.pooled_ground(v, cells.frame_votes(v))


@query(VOTES + " SELECT cell, quantile_disc(greatest(h50 - ground, 0), 0.5) AS h50_above, quantile_disc(greatest(h95 - ground, 0), 0.5) AS h95_above FROM fv GROUP BY 1")
def per_frame_datum(s, d):
    return cells.own_ground(votes(s, d))


GROUNDS = ", grounds AS (SELECT cell % 10 AS col, CAST(cell // 10 AS BIGINT) AS row, quantile_disc(height, 0.25) AS ground FROM votes GROUP BY cell)"


@query(GROUNDS + ", f AS (SELECT *, coalesce(ground - lag(ground) OVER w > 0.0 AND lead(ground) OVER w - ground > 0.0, false) AS foot FROM grounds WINDOW w AS (PARTITION BY col ORDER BY row)) SELECT col AS \"column\", row, ground, coalesce(row >= min(row) FILTER (foot) OVER (PARTITION BY col), false) AS on_slope FROM f")
def slope_foot(s, d):
    g = shim.votes(s, d).groupBy("cell").agg(stats.nearest_rank("height", 0.25).alias("ground"))
    return cells.slope_foot(g.select((F.col("cell") % 10).alias("column"), F.floor(F.col("cell") / 10).alias("row"), "ground"), 0.0)


@query(", a AS (SELECT cell, max(height) AS before FROM votes WHERE cell < 40 AND frame % 2 = 0 GROUP BY 1), b AS (SELECT cell, max(height) AS after FROM votes WHERE cell > 10 AND frame % 2 = 1 GROUP BY 1) SELECT coalesce(a.cell, b.cell) AS cell, before, after, after - before AS delta, CASE WHEN a.cell IS NULL THEN 'new' WHEN b.cell IS NULL THEN 'not observed' ELSE 'both' END AS status FROM a FULL JOIN b ON a.cell = b.cell")
def assessment_compare_full_outer(s, d):
    v = shim.votes(s, d)
    a, b = (v.where(c).groupBy("cell").agg(F.max("height").alias("h")) for c in ("cell < 40 AND frame % 2 = 0", "cell > 10 AND frame % 2 = 1"))
    return cells.compare(a, b, ["cell"], "h")


@query(", c AS (SELECT frame, count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (t AND NOT g) AS fn FROM (SELECT frame, height > 0.3 AS t, voxel > 40 AS g FROM votes) GROUP BY 1) SELECT frame, tp, fp, fn, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn)::DOUBLE END AS iou, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END AS recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END AS \"precision\" FROM c")
def mask_score_iou(s, d):
    return cells.mask_scores(shim.votes(s, d).select("frame", (F.col("height") > 0.3).alias("t"), (F.col("voxel") > 40).alias("g")), "t", "g", ["frame"])


@query(", o AS (SELECT l_extendedprice / l_quantity AS truth, l_extendedprice / l_quantity * (1 + l_tax) AS predicted FROM lineitem) SELECT count(*) AS n, sum(truth * predicted) / sum(predicted * predicted) AS factor, regr_slope(truth, predicted) AS slope, round(regr_intercept(truth, predicted), 3) AS intercept, round(sqrt(avg((predicted - truth) * (predicted - truth))), 4) AS rms, round(max(abs(predicted - truth)), 4) AS max_abs, avg(abs(predicted - truth) / abs(truth)) AS abs_rel FROM o")
def error_model(s, d):
    o = shim.table(s, d, "lineitem").select((F.col("l_extendedprice") / F.col("l_quantity")).alias("truth"), (F.col("l_extendedprice") / F.col("l_quantity") * (1 + F.col("l_tax"))).alias("predicted"))
    return cells.error_model(o).withColumns({"intercept": F.round("intercept", 3), "rms": F.round("rms", 4), "max_abs": F.round("max_abs", 4)})


@query(", m AS (SELECT l_suppkey AS object_id, count(*) AS n, avg(l_quantity) AS mean, quantile_disc(l_quantity, 0.5) AS median, max(l_quantity) - min(l_quantity) AS \"range\" FROM lineitem GROUP BY 1), o AS (SELECT l_suppkey AS object_id, quantile_disc(abs(l_quantity - median), 0.5) * 1.4826 AS nmad FROM lineitem JOIN m ON object_id = l_suppkey GROUP BY 1) SELECT object_id, n, mean, median, \"range\", CASE WHEN n >= 3 THEN nmad END AS nmad FROM m JOIN o USING (object_id)")
def trial_stats_nmad(s, d):
    return cells.trial_statistics(shim.table(s, d, "lineitem").select(F.col("l_suppkey").alias("object_id"), "l_quantity"), "object_id", "l_quantity")


@query("SELECT doc_id, md5(text) AS digest FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1")
def duplicate_mask_trials(s, d):
    t = shim.table(s, d, "documents").select("doc_id", F.md5("text").alias("digest"))
    return t.withColumn("_r", F.row_number().over(Window.partitionBy("digest").orderBy("doc_id"))).where("_r > 1").drop("_r")


@query("SELECT CAST(floor(x / 0.1) AS BIGINT) AS vx, CAST(floor(y / 0.1) AS BIGINT) AS vy, CAST(floor(z / 0.1) AS BIGINT) AS vz, round(sum(x * w) / sum(w), 9) AS x, round(sum(y * w) / sum(w), 9) AS y, round(sum(z * w) / sum(w), 9) AS z, avg(w) AS w, count(*) AS n FROM points GROUP BY 1, 2, 3")
def voxel_centroids(s, d):
    return cloud.voxel_centroids(shim.points(s, d), 0.1).withColumns({c: F.round(c, 9) for c in "xyz"})


@query("SELECT point_id, w / avg(w) OVER () AS weight FROM points")
def weight_normalise(s, d):
    return cloud.weights_to_mean_one(shim.points(s, d)).select("point_id", "weight")


@query("SELECT frame, least(greatest(1.05, quantile_disc(conf, 0.4)), quantile_disc(conf, 0.9)) AS floor, count(*) AS pixels FROM (SELECT l_suppkey AS frame, l_quantity / 20 AS conf FROM lineitem) GROUP BY 1")
def confidence_floor_per_frame(s, d):
    return cloud.confidence_floor(shim.table(s, d, "lineitem").select(F.col("l_suppkey").alias("frame"), (F.col("l_quantity") / 20).alias("conf")), "frame", "conf")


@query("SELECT g, quantile_disc(y, 0.98) AS p98, quantile_disc(y, 0.02) AS p2, count(*) AS n, quantile_disc(y, 0.98) - quantile_disc(y, 0.02) AS extent FROM (SELECT *, point_id % 4 AS g FROM points) GROUP BY 1")
def vertical_extent(s, d):
    return cloud.height_profile(shim.points(s, d).withColumn("g", F.col("point_id") % 4), ["g"], "y")


@query(", p AS (SELECT point_id, point_id % 4 AS g, y FROM points), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY y, point_id) AS lo, row_number() OVER (PARTITION BY g ORDER BY y DESC, point_id DESC) AS hi, least(greatest(40, floor(count(*) OVER (PARTITION BY g) * 0.1)), floor(count(*) OVER (PARTITION BY g) / 2.0)) AS n FROM p) SELECT point_id, g, CASE WHEN lo <= n THEN 'low' ELSE 'high' END AS tail FROM r WHERE lo <= n OR hi <= n")
def endpoint_tails(s, d):
    return cloud.tails(shim.points(s, d).withColumn("g", F.col("point_id") % 4), ["g"], "y", "point_id").select("point_id", "g", "tail")


@query(
    ", b AS (SELECT point_id % 2 AS g, floor(y / 0.005::DOUBLE)::BIGINT AS bin, count(*) AS n FROM points GROUP BY 1, 2), p AS (SELECT *, max(n) OVER w AS most, coalesce(max(n) OVER (PARTITION BY g ORDER BY bin RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS below, quantile_cont(n, 0.5) OVER w AS middle FROM b WINDOW w AS (PARTITION BY g ORDER BY bin RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING))"
    " SELECT g, bin, bin * 0.005::DOUBLE AS level, n FROM p WHERE n = most AND below < n AND n >= 2 * middle"
)
def horizontal_levels_peaks(s, d):
    return cloud.horizontal_levels(shim.points(s, d).withColumn("g", F.col("point_id") % 2), ["g"], "y")


def _det(*rows: str) -> str:
    (a, b, c), (d, e, f), (g, h, i) = (r.split() for r in rows)
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


WHOLE = _det("sxx sxz sx", "sxz szz sz", "sx sz s")
SOLVED = {"a": _det("sxy sxz sx", "szy szz sz", "sy sz s"), "b": _det("sxx sxy sx", "sxz szy sz", "sx sy s"), "c": _det("sxx sxz sxy", "sxz szz szy", "sx sz sy")}


@query(
    ", q AS (SELECT point_id % 4 AS g, sum(w) AS s, sum(w * x) AS sx, sum(w * z) AS sz, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * z * z) AS szz, sum(w * x * z) AS sxz, sum(w * x * y) AS sxy, sum(w * z * y) AS szy FROM points GROUP BY 1)"
    + f" SELECT g, {', '.join(f'round({v} / nullif({WHOLE}, 0), 6) AS {k}' for k, v in SOLVED.items())} FROM q"
)
def plane_lsq_refine(s, d):
    fit = cloud.plane_fit(shim.points(s, d).withColumn("g", F.col("point_id") % 4), ["g"])
    return fit.select("g", *(F.round(c, 6).alias(c) for c in "abc"))


@query(
    ", o AS (SELECT DISTINCT w::BIGINT AS g, floor(x / 0.1::DOUBLE)::BIGINT AS vx, floor(y / 0.1::DOUBLE)::BIGINT AS vy, floor(z / 0.1::DOUBLE)::BIGINT AS vz FROM points),"
    " c AS (SELECT g, vx, vy, vz, label FROM (WITH RECURSIVE r AS (SELECT g, (vx, vy, vz) AS root, vx, vy, vz FROM o UNION SELECT r.g, root, o.vx, o.vy, o.vz FROM r JOIN o ON o.g = r.g AND abs(o.vx - r.vx) <= 1 AND abs(o.vy - r.vy) <= 1 AND abs(o.vz - r.vz) <= 1) SELECT g, vx, vy, vz, min(root) AS label FROM r GROUP BY 1, 2, 3, 4)),"
    " n AS (SELECT g, label, count(*) AS n FROM c GROUP BY 1, 2) SELECT g, CAST(sum(n) AS BIGINT) AS voxels, count(*) AS components, max(n) / sum(n) AS largest_share FROM n GROUP BY 1"
)
def connected_voxels(s, d):
    cell = lambda c: F.floor(F.col(c) / 0.1).alias(f"v{c}")
    return cloud.connected_voxels(shim.points(s, d).select(F.col("w").cast("long").alias("g"), *map(cell, "xyz")), "g")


@query(", b AS (SELECT DISTINCT l_suppkey AS frame, l_partkey % 500 AS pos FROM lineitem), g AS (SELECT frame, pos, pos - row_number() OVER (PARTITION BY frame ORDER BY pos) AS g FROM b) SELECT frame, min(pos) AS start, count(*) AS \"count\" FROM g GROUP BY frame, g")
def rle_encode(s, d):
    return documents.rle_encode(bits(s, d), "frame", "at")


def bits(s, d):
    return shim.table(s, d, "lineitem").select(F.col("l_suppkey").alias("frame"), (F.col("l_partkey") % 500).alias("at"))


@query("SELECT DISTINCT l_suppkey AS frame, l_partkey % 500 AS at FROM lineitem")
def rle_decode(s, d):
    return documents.rle_decode(documents.rle_encode(bits(s, d), "frame", "at"), "frame", "at")


def assessments(s, d):
    """Assessment texts built from windows: a cell for each window with two votes, every seventh text broken."""
    w = shim.windows(s, d)
    vote = lambda k: F.struct(((F.col("window_index") + k) % 5).alias("frameIndex"), (F.col("cells") + k).alias("sampleCount"), (F.coalesce("height", F.lit(0.0)) + 0.125 * k).alias("h95M"))
    cell = F.struct((F.col("window_index") * 0.0625).alias("localGroundM"), F.col("height").alias("h95M"), F.col("height").alias("extent95M"), F.when(F.col("level").isNotNull(), "measured").otherwise("abstained").alias("status"), F.array(F.col("window_index") % 5).alias("evidenceFrameIndices"), F.array(vote(0), vote(1)).alias("frameVotes"))
    doc = F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("window_index", cell.alias("cell")))).alias("l")))
    listed = w.groupBy("segment_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("window_index", cell.alias("cell")))), lambda x: x["cell"]).alias("measurements"))
    plain, wrapped = F.to_json(F.struct("measurements")), F.to_json(F.struct(F.struct("measurements").alias("assessment")))
    return listed.select("segment_id", F.when(F.col("segment_id") % 7 == 0, "no {json").when(F.col("segment_id") % 2 == 0, wrapped).otherwise(plain).alias("doc"))


@query(""", v AS (SELECT segment_id, (window_index + k) % 5 + 1 AS frame, cells + k AS n, coalesce(height, 0) + 0.125 * k - window_index * 0.0625 AS over, abs(coalesce(height, 0) + 0.125 * k - height) AS off FROM windows, range(2) r(k) WHERE segment_id % 7 <> 0),
f AS (SELECT segment_id, frame, count(*) AS cells, CAST(sum(n) AS BIGINT) AS samples, median(over) AS median_height, max(over) AS max_height, max(off) AS disagreement FROM v GROUP BY 1, 2), e AS (SELECT segment_id, window_index % 5 + 1 AS frame, count(*) AS evidence FROM windows WHERE segment_id % 7 <> 0 GROUP BY 1, 2)
SELECT segment_id, CAST(frame AS INT) AS frame, coalesce(cells, 0) AS cells, coalesce(samples, 0) AS samples, round(median_height, 9) AS median_height, round(max_height, 9) AS max_height, round(disagreement, 9) AS disagreement, coalesce(evidence, 0) AS evidence FROM f FULL JOIN e USING (segment_id, frame)""")
def frame_readings(s, d):
    out = documents.frame_readings(documents.cells_of(assessments(s, d), ["segment_id"], "doc"), ["segment_id"])
    return out.withColumns({c: F.round(c, 9) for c in ("median_height", "max_height", "disagreement")})


@query("SELECT segment_id, quantile_disc(height, 0.95) AS p95, max(height) AS tallest, count(*) AS cells FROM windows WHERE segment_id % 7 <> 0 AND level IS NOT NULL GROUP BY 1")
def assessment_projection(s, d):
    return documents.stretch_projection(documents.cells_of(assessments(s, d), ["segment_id"], "doc"), ["segment_id"])


@query("SELECT doc_id, sha256(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id || '|' || length(source) || ':' || source) AS key FROM documents")
def content_cache_key(s, d):
    return shim.table(s, d, "documents").select("doc_id", text.content_key(F.col("doc_id"), F.col("source")).alias("key"))


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, event_id % 10 ORDER BY event_id) = 1")
def dedupe_generation(s, d):
    e = shim.table(s, d, "events").select("event_id", "user_id", "event_type")
    first = Window.partitionBy("user_id", "event_type", F.col("event_id") % 10).orderBy("event_id")
    return e.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN 'done' WHEN event_id % 5 < 2 THEN 'retry' ELSE 'poison' END AS fate FROM events")
def retry_poison_split(s, d):
    from kerbside.streaming.messages import fate

    return shim.table(s, d, "events").select("event_id", fate(F.col("event_type") == "error", (F.col("event_id") % 5 + 1).cast("int")).alias("fate"))


def judged_cells(s, d):
    """Cells of the votes by supplier, with stand-ins for structures and gaps."""
    v = shim.table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("column"), (F.col("l_partkey") % 60).alias("cell")).agg(F.count("*").alias("samples"), stats.nearest_rank("l_quantity", 0.95).alias("h"), (F.max("l_quantity") - F.min("l_quantity")).alias("s"), F.sum((F.col("l_tax") == 0).cast("int")).alias("structure"))
    enough = F.col("samples") >= 3
    cell = v.select("column", "cell", "samples", F.when(enough, F.col("h") / 20).alias("h95"), F.when(enough, F.col("s") / 100).alias("spread"), F.col("structure"), (F.col("s") / 50).alias("gap"))
    return cells.cell_status(cell)


JUDGED = ", v AS (SELECT l_suppkey % 20 AS col, l_partkey % 60 AS cell, count(*) AS samples, quantile_disc(l_quantity, 0.95) AS h, max(l_quantity) - min(l_quantity) AS s, count(*) FILTER (l_tax = 0) AS structure FROM lineitem GROUP BY 1, 2), c AS (SELECT col, cell, samples, CASE WHEN samples >= 3 THEN h / 20 END AS h95, CASE WHEN samples >= 3 THEN s / 100 END AS spread, structure, s / 50 AS gap FROM v), j AS (SELECT *, CASE WHEN structure >= 3 THEN 'structure' WHEN h95 IS NULL THEN 'abstained' WHEN h95 > 2.0 THEN 'canopy' WHEN gap > 0.5 THEN 'canopy' ELSE 'measured' END AS status FROM c)"


@query(JUDGED + " SELECT col AS \"column\", cell, status FROM j")
def cell_status(s, d):
    return judged_cells(s, d).select("column", "cell", "status")


@query(JUDGED + ", q AS (SELECT col, count(*) AS cells, count(*) FILTER (status = 'measured') AS measured, count(*) FILTER (status = 'abstained') AS abstained, max(spread) AS spread, count(*) FILTER (h95 > 0.1) AS above_middle, count(*) FILTER (h95 > 0.3) AS above_tall FROM j GROUP BY 1) SELECT col AS \"column\", cells, measured, abstained, spread, above_middle, above_tall, measured / cells::DOUBLE AS coverage, concat_ws('; ', CASE WHEN measured = 0 THEN 'nothing measured' END, CASE WHEN abstained > measured THEN 'mostly abstained' END, CASE WHEN spread > 0.2 THEN 'frames disagree' END) AS blockers FROM q")
def quality_summary(s, d):
    return cells.quality_summary(judged_cells(s, d), ["column"])


@query(JUDGED + " SELECT col AS \"column\", arg_max(cell, (h95, -cell)) AS tallest, arg_min(cell, (h95, cell)) AS lowest, arg_max(cell, (spread, -cell)) AS widest, arg_min(cell, (samples, cell)) AS weakest FROM j WHERE h95 IS NOT NULL GROUP BY 1")
def review_samples(s, d):
    return cells.review_picks(judged_cells(s, d), ["column"], "cell")


@query(", b AS (SELECT label, list_position(embedding, list_max(embedding)) - 1 AS class FROM embeddings), n AS (SELECT label, class, count(*) AS n FROM b GROUP BY 1, 2) SELECT label, CAST(class AS BIGINT) AS class, n, n / sum(n) OVER (PARTITION BY label) AS fraction FROM n")
def class_fractions_argmax(s, d):
    return cells.class_fractions(shim.table(s, d, "embeddings"), ["label"], "embedding")


@query(", p AS (SELECT l_suppkey AS g, l_quantity / 10 AS y FROM lineitem), t AS (SELECT g, quantile_disc(y, 0.98) AS p98 FROM p GROUP BY 1), n AS (SELECT p.g, y FROM p JOIN t ON p.g = t.g AND abs(y - p98) <= 0.3), m AS (SELECT g, quantile_disc(y, 0.5) AS m, count(*) AS n FROM n GROUP BY 1), r AS (SELECT n.g, quantile_disc(abs(y - m), 0.5) * 1.4826 AS roughness FROM n JOIN m ON n.g = m.g GROUP BY 1) SELECT t.g, p98, n, roughness FROM t JOIN m ON m.g = t.g JOIN r ON r.g = t.g")
def height_p98_roughness(s, d):
    return cloud.top_roughness(shim.table(s, d, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_quantity") / 10).alias("y")), ["g"], "y", 0.3)


@query(DRIVE + ", e AS (SELECT session_id, min(distance) AS d0, max(distance) AS d1 FROM drive GROUP BY 1), t AS (SELECT session_id, k, d0 + (d1 - d0) * k / 15 AS target FROM e, range(16) r(k)), n AS (SELECT t.session_id, k, frame_id, row_number() OVER (PARTITION BY t.session_id, k ORDER BY abs(distance - target), distance) AS i FROM t JOIN drive USING (session_id)) SELECT session_id, frame_id, CAST(min(k) AS INT) AS k FROM n WHERE i = 1 GROUP BY 1, 2")
def even_distance_selection(s, d):
    return telemetry.even_selection(drive(s, d), 16)


@query(", v AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS ord, speed * 0.2::DOUBLE AS x, accuracy * 0.05::DOUBLE AS y FROM fixes), k AS (WITH RECURSIVE r AS (SELECT session_id, ord, x, y, true AS kept FROM v WHERE ord = 1 UNION ALL SELECT session_id, ord, CASE WHEN far THEN x ELSE px END, CASE WHEN far THEN y ELSE py END, far FROM (SELECT v.*, r.x AS px, r.y AS py, sqrt((v.x - r.x) ** 2 + (v.y - r.y) ** 2) >= 0.5 AS far FROM r JOIN v ON v.session_id = r.session_id AND v.ord = r.ord + 1)) SELECT * FROM r WHERE kept) SELECT session_id, ord, x, y FROM k")
def road_edge_thinning(s, d):
    path = shim.fixes(s, d).select("session_id", F.row_number().over(telemetry.ordered("event_id")).alias("ord"), (F.col("speed") * 0.2).alias("x"), (F.col("accuracy") * 0.05).alias("y"))
    return telemetry.thinned(path, "session_id", "ord", 0.5)


@query(
    ", f AS (SELECT *, cos(radians(lat)) * 111320.0::DOUBLE AS flat, "
    + ", ".join(f"coalesce(lead({c}) OVER w, {c}) - coalesce(lag({c}) OVER w, {c}) AS d{c}" for c in ("lon", "lat"))
    + " FROM fixes WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id)), g AS (SELECT *, dlon * flat AS x, dlat * 111320.0::DOUBLE AS y FROM f), h AS (SELECT *, sqrt(x * x + y * y) AS l FROM g WHERE sqrt(x * x + y * y) > 0),"
    + " e AS (SELECT *, -y / l * 5 / flat AS east, x / l * 5 / 111320.0::DOUBLE AS north FROM h), p AS (SELECT session_id, list([round(lon + east, 9), round(lat + north, 9)] ORDER BY t, event_id) AS lf, list([round(lon - east, 9), round(lat - north, 9)] ORDER BY t DESC, event_id DESC) AS rt FROM e GROUP BY 1 HAVING count(*) >= 2), r AS (SELECT session_id, list_concat(list_concat(lf, rt), lf[1:1]) AS ring FROM p)"
    + " SELECT session_id, len(ring) AS corners, 'Polygon' AS type, array_to_string(list_transform(ring, lambda c: CAST(round(c[1] * 1e9) AS BIGINT) || ' ' || CAST(round(c[2] * 1e9) AS BIGINT)), ', ') AS ring FROM r"
)
def geojson_band(s, d):
    """Read back from the polygons' text."""
    made = documents.band_polygon(shim.fixes(s, d).withColumn("ord", F.struct("t", "event_id")), "session_id", "ord", 5.0)
    read = F.from_json("geometry", "type string, coordinates array<array<array<double>>>")
    corner = F.transform(read["coordinates"][0], lambda c: F.concat_ws(" ", *(F.round(c[k] * 1e9).cast("bigint").cast("string") for k in range(2))))
    return made.select("session_id", "corners", read["type"].alias("type"), F.array_join(corner, ", ").alias("ring"))


@query(", p AS (SELECT event_id % 400 AS canonical, event_id, lat, lon FROM fixes QUALIFY row_number() OVER (PARTITION BY event_id % 400 ORDER BY event_id DESC) = 1) SELECT 'frame_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '.jpg' AS name, CAST(c_custkey AS INT) AS canonical, lat, lon FROM customer LEFT JOIN p ON canonical = c_custkey")
def frame_join_positions(s, d):
    frames = shim.table(s, d, "customer").select(F.concat(F.lit("frame_"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit(".jpg")).alias("name"))
    packets = shim.fixes(s, d).select((F.col("event_id") % 400).cast("int").alias("canonical"), "event_id", "lat", "lon")
    return documents.with_positions(frames, packets, "name", "event_id")


@query("SELECT segment_id, window_index, coalesce(n.cells, o.cells) AS cells FROM (SELECT segment_id, window_index, cells FROM windows) o LEFT JOIN (SELECT segment_id, window_index, cells + 100 AS cells FROM windows WHERE cells < 5) n USING (segment_id, window_index)")
def merge_frame_readings(s, d):
    old = shim.windows(s, d).select("segment_id", "window_index", "cells")
    return changes.patch(old, old.where("cells < 5").withColumn("cells", F.col("cells") + 100), ["segment_id", "window_index"])


@query(f"SELECT session_id, {SUMMARY} FROM readings GROUP BY 1")
def session_detail_counts(s, d):
    return readings.summary(source(s, d), ["session_id"])


@query("SELECT coalesce(a.order_id, b.order_id) AS order_id, coalesce(a.status, b.status) AS status FROM (SELECT * FROM worders WHERE order_id % 3 <> 0) a FULL JOIN (SELECT order_id, upper(status) AS status FROM worders WHERE order_id % 2 = 0) b ON a.order_id = b.order_id")
def merge_observations_local_wins(s, d):
    o = shim.orders(s, d).select("order_id", "status")
    return changes.merge_observations(o.where("order_id % 3 <> 0"), o.where("order_id % 2 = 0").withColumn("status", F.upper("status")), ["order_id"], "status")


@query(" SELECT * FROM points ORDER BY md5('0:' || point_id), point_id LIMIT 100")
def uniform_cap(s, d):
    return cloud.uniform_cap(shim.points(s, d), "point_id", 100)


@query(", gone AS (SELECT session_id FROM sessions WHERE session_id % 10 = 0) SELECT segment_id, session_id, state FROM segments WHERE session_id NOT IN (SELECT session_id FROM gone)")
def cascade_delete(s, d):
    sessions = shim.sessions(s, d)
    gone = sessions.where("session_id % 10 = 0")
    left = changes.cascade_delete(sessions, {"segments": (shim.segments(s, d), "session_id")}, gone, "session_id")[1]
    return left["segments"].select("segment_id", "session_id", "state")
