"""Ends, planes, sittings, reviews, readiness and areas as named queries, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside import shim
from kerbside.operators import measures, work
from kerbside.plans.catalog import JUDGED, judged_cells, query

#: A unit normal and an offset.
PLANE = (0.36, 0.8, 0.48, 0.1)
HEIGHT = "x * 0.36 + y * 0.8 + z * 0.48"
GROUPED = f", p AS (SELECT *, point_id % 3 AS g, {HEIGHT} + 0.1 AS h FROM points), e AS (SELECT g, quantile_disc(h, 0.02) AS bottom, quantile_disc(h, 0.98) AS top, count(h) AS n FROM p GROUP BY 1)"


def grouped(s, d) -> DataFrame:
    return shim.points(s, d).withColumns({"g": F.col("point_id") % 3, "h": measures.above(PLANE)})


@query(
    GROUPED
    + """, b AS (SELECT p.g, h, unnest(list_filter([CASE WHEN h >= bottom - 0.05 AND h <= bottom + 0.05 THEN 'bottom' END, CASE WHEN h >= top - 0.05 AND h <= top + 0.05 THEN 'top' END], lambda v: v IS NOT NULL)) AS side FROM p JOIN e USING (g)),
m AS (SELECT g, side, quantile_disc(h, 0.5) AS middle FROM b GROUP BY 1, 2), o AS (SELECT g, side, CASE WHEN count(*) >= 3 THEN quantile_disc(abs(h - middle), 0.5) * 1.4826 ELSE 0 END AS scatter FROM b JOIN m USING (g, side) GROUP BY 1, 2),
u AS (SELECT g, sqrt(sum(scatter * scatter)) AS uncertainty FROM o GROUP BY 1) SELECT g, n, round(CASE WHEN n >= 40 THEN top - bottom END, 9) AS extent, round(CASE WHEN n >= 40 THEN uncertainty END, 9) AS uncertainty FROM e LEFT JOIN u USING (g)"""
)
def extent_uncertainty(s, d):
    found = measures.extent_with_doubt(grouped(s, d), ["g"], "h", least=40)
    return found.withColumns({c: F.round(c, 9) for c in ("extent", "uncertainty")})


CENTRES = ", ".join(f"avg(CASE WHEN abs(h - {e}) <= 0.05 THEN {c} END) AS {e}_{c}" for e in ("bottom", "top") for c in "xyz")
ACROSS = "(top_x - bottom_x) * 0.36 + (top_y - bottom_y) * 0.8 + (top_z - bottom_z) * 0.48"
APART = "((top_x - bottom_x) ^ 2 + (top_y - bottom_y) ^ 2 + (top_z - bottom_z) ^ 2)"
OVER = "((top_x + bottom_x) / 2 * 0.36 + (top_y + bottom_y) / 2 * 0.8 + (top_z + bottom_z) / 2 * 0.48 + 0.1)"
RULER = [f"(top_{c} + bottom_{c}) / 2 + ({e} - {OVER}) * {n} AS ruler_{e}_{c}" for e in ("bottom", "top") for c, n in zip("xyz", PLANE, strict=False)]


@query(GROUPED + f", c AS (SELECT p.g, bottom, top, {CENTRES} FROM p JOIN e USING (g) GROUP BY 1, 2, 3), r AS (SELECT *, sqrt({APART}) AS distance, sqrt(greatest(0, {APART} - ({ACROSS}) ^ 2)) AS lateral, {', '.join(RULER)} FROM c) SELECT g, round(COLUMNS(* EXCLUDE g), 7) FROM r")
def end_geometry(s, d):
    found = measures.end_geometry(grouped(s, d), ["g"], PLANE)
    return found.select("g", *(F.round(c, 7).alias(c) for c in found.columns if c != "g"))


@query(
    f", p AS (SELECT point_id % 3 AS g, {HEIGHT} + 0.0 AS h FROM points), e AS (SELECT g, quantile_disc(h, 0.02) AS elevation, count(h) AS n FROM p GROUP BY 1) SELECT g, round(elevation, 9) AS elevation, n, count(*) FILTER (abs(h - elevation) <= 0.035) AS inliers, round(sqrt(avg(CASE WHEN abs(h - elevation) <= 0.035 THEN (h - elevation) ^ 2 END)), 9) AS rmse, count(*) FILTER (abs(h - elevation) <= 0.035) / n AS inlier_share, count(*) FILTER (h - elevation < -0.05) / n AS below_share FROM p JOIN e USING (g) GROUP BY g, elevation, n"
)
def plane_low_anchor(s, d):
    found = measures.anchored(grouped(s, d), ["g"], PLANE[:3])
    return found.withColumns({c: F.round(c, 9) for c in ("elevation", "rmse")})


@query(
    ", l AS (SELECT cell, height AS level, count(*) AS n FROM votes GROUP BY 1, 2), w AS (SELECT DISTINCT cell, cell / 40.0::DOUBLE AS expected FROM votes), f AS (SELECT cell, expected, arg_min(level, (abs(level - expected), -n, level)) AS level FROM w JOIN l USING (cell) WHERE abs(level - expected) <= 0.15 GROUP BY 1, 2) SELECT w.cell, w.expected, level FROM w LEFT JOIN f USING (cell, expected)"
)
def level_near_expected(s, d):
    v = shim.votes(s, d)
    levels = v.groupBy("cell", F.col("height").alias("level")).agg(F.count("*").alias("n"))
    wanted = v.select("cell", (F.col("cell") / 40.0).alias("expected")).distinct()
    return measures.level_near(levels, wanted, ["cell"])


@query(", t AS (SELECT l_suppkey AS object_id, CASE WHEN l_linenumber < 6 THEN l_orderkey % 4 END AS sitting, count(*) AS n, avg(l_quantity) AS mean, max(l_quantity) - min(l_quantity) AS r FROM lineitem GROUP BY 1, 2) SELECT object_id, count(*) AS sittings, max(CASE WHEN n >= 2 THEN r END) AS within, CASE WHEN count(*) >= 2 THEN max(mean) - min(mean) END AS between FROM t GROUP BY 1")
def trial_sitting_ranges(s, d):
    trials = shim.table(s, d, "lineitem").select(F.col("l_suppkey").alias("object_id"), F.when(F.col("l_linenumber") < 6, F.col("l_orderkey") % 4).alias("sitting"), "l_quantity")
    return measures.sitting_ranges(trials, "object_id", "sitting", "l_quantity")


PICKS = {"lowest": "h95, cell", "median": "abs(h95 - middle), cell", "highest": "-h95, cell", "least supported": "samples, cell", "most disputed": "-coalesce(spread, 0), cell"}


@query(
    JUDGED
    + ", k AS (SELECT col, quantile_disc(h95, 0.5) AS middle FROM j WHERE status = 'measured' GROUP BY 1), g AS (SELECT col, count(*) AS cells, "
    + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ("measured", "abstained", "canopy", "structure"))
    + ", min(h95) FILTER (status = 'measured') AS lowest_h, max(h95) FILTER (status = 'measured') AS highest_h, ["
    + ", ".join(f"{{'reason': '{r}', 'at': arg_min(cell, ({o})) FILTER (status = 'measured')}}" for r, o in PICKS.items())
    + ", {'reason': 'abstained', 'at': min(cell) FILTER (status = 'abstained')}] AS ps FROM j LEFT JOIN k USING (col) GROUP BY 1)"
    + ' SELECT col AS "column", cells, measured, abstained, canopy, structure, lowest_h, highest_h, measured / cells::DOUBLE AS coverage, array_to_string(list_transform(list_filter(ps, lambda p, i: p.at IS NOT NULL AND list_position(list_transform(ps, lambda q: q.at), p.at) = i), lambda p: p.at || \':\' || p.reason), \',\') AS picks FROM g'
)
def review_evidence(s, d):
    return measures.review_evidence(judged_cells(s, d), ["column"], "cell")


@query(
    ", i AS (SELECT session_id, state, row_number() OVER (PARTITION BY session_id ORDER BY segment_id) - 1 AS k FROM segments), c AS (SELECT session_id, CASE WHEN max(k) FILTER (state <> 'queued') IS NOT NULL THEN max(k) FILTER (state <> 'queued') END AS last_index FROM i GROUP BY 1), r AS (SELECT session_id, count(*) FILTER (state = 'ready') AS n_ready, count(*) AS n_segments FROM i GROUP BY 1), b AS (SELECT s.session_id, last_index, coalesce(n_ready, 0) AS n_ready, coalesce(n_segments, 0) AS n_segments FROM sessions s LEFT JOIN c USING (session_id) LEFT JOIN r USING (session_id)) SELECT *, CASE WHEN n_ready = last_index + 1 THEN 'ready' WHEN n_segments > 0 THEN 'processing' ELSE 'waiting' END AS state FROM b"
)
def session_readiness(s, d):
    """The last index is that of the last segment that is not queued."""
    seg = shim.segments(s, d).select("session_id", "state", (F.row_number().over(Window.partitionBy("session_id").orderBy("segment_id")) - 1).cast("long").alias("k"))
    last = seg.groupBy("session_id").agg(F.max(F.when(F.col("state") != "queued", F.col("k"))).alias("last_index"))
    return measures.readiness(shim.sessions(s, d).select("session_id").join(last, "session_id", "left"), seg)


LONG = "coalesce(track_m, end_m - start_m, 150.0)"
TRACKED = ", t AS (SELECT segment_id AS order_id, start_m, end_m, level, CASE WHEN window_index % 3 = 0 THEN cells::DOUBLE END AS track_m, CASE WHEN cells % 4 <> 0 THEN cells / 8.0::DOUBLE - 23 END AS lat, CASE WHEN cells % 4 <> 0 THEN cells / 4.0::DOUBLE - 46 END AS lon FROM windows)"


def tracked(s, d) -> DataFrame:
    placed = F.col("cells") % 4 != 0
    w = shim.windows(s, d).withColumnRenamed("segment_id", "order_id")
    return w.withColumns({"track_m": F.when(F.col("window_index") % 3 == 0, F.col("cells").cast("double")), "lat": F.when(placed, F.col("cells") / 8.0 - 23), "lon": F.when(placed, F.col("cells") / 4.0 - 46)})


@query(TRACKED + f" SELECT order_id, sum({LONG}) * 10 AS area_m2, max(level) AS worst, count(*) AS windows, avg(lat) AS lat, avg(lon) AS lon FROM t GROUP BY 1")
def order_evidence_centre(s, d):
    return work.evidence_with_centre(tracked(s, d))


AREAS = TRACKED + f", a AS (SELECT order_id, sum({LONG}) * 10 AS area_m2 FROM t GROUP BY 1)"


@query(AREAS + " SELECT team_id, coalesce(sum(area_m2) FILTER (status = 'done'), 0) AS area_m2, count(*) FILTER (status = 'done') AS n_done FROM worders LEFT JOIN a USING (order_id) GROUP BY 1")
def team_done_area(s, d):
    return work.done_area(shim.orders(s, d), work.evidence_with_centre(tracked(s, d)), ["team_id"])


@query(AREAS + ", k AS (SELECT *, status = 'done' AND created_at::TIMESTAMP >= TIMESTAMP '1995-01-01' AS done FROM worders LEFT JOIN a USING (order_id)) SELECT coalesce(sum(area_m2) FILTER (done), 0) AS area_m2, count(*) FILTER (done) AS n_done FROM k")
def kpi_done_area(s, d):
    return work.done_area(shim.orders(s, d), work.evidence_with_centre(tracked(s, d)), [], F.lit("1995-01-01").cast("timestamp"))
