"""Depth pixels to cell heights as named queries, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside import shim
from kerbside.operators import cells, grid
from kerbside.operators.cloud import points_of_tracks
from kerbside.plans.catalog import VOTES, query, votes

#: A lens (fx, fy, cx, cy) and the grid's measures.
LENS = (40.0, 40.0, 20.0, 20.0)
GRID = {"size_m": 4.0, "length_m": 8.0, "widest_m": 4.0, "side": 1, "tallest_m": 3.0, "rmse": 0.2, "voxel_m": 0.1}

PIXELS = """, pixels AS (SELECT l_suppkey % 6 AS frame, l_orderkey % 40 AS r, l_partkey % 40 AS c, CASE WHEN max(l_quantity) = 13 THEN NULL ELSE min(1 + l_quantity / 10) END AS depth, max(1 + l_discount * 10) AS conf, (l_orderkey % 40 + l_partkey % 40) % 5 <> 0 AS mask, (l_orderkey % 40) * (l_partkey % 40) % 97 = 1 AS structure FROM lineitem GROUP BY ALL)"""


def pixels(s, d) -> DataFrame:
    q = F.col("l_quantity")
    at = shim.table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 6).alias("frame"), (F.col("l_orderkey") % 40).alias("r"), (F.col("l_partkey") % 40).alias("c"))
    p = at.agg(F.when(F.max(q) != 13, F.min(1 + q / 10)).alias("depth"), F.max(1 + F.col("l_discount") * 10).alias("conf"))
    return p.withColumns({"mask": (F.col("r") + F.col("c")) % 5 != 0, "structure": F.col("r") * F.col("c") % 97 == 1})


STEPS = ", ".join(f"CASE WHEN abs({m}({at}) OVER {o} - {at}) = 1 THEN abs({m}(depth) OVER {o} - depth) / depth END" for at, o in (("c", "w"), ("r", "v")) for m in ("lag", "lead"))
REJECTS = PIXELS + f", steps AS (SELECT *, coalesce(greatest({STEPS}), 0) AS step FROM pixels WINDOW w AS (PARTITION BY frame, r ORDER BY c), v AS (PARTITION BY frame, c ORDER BY r)), rejects AS (SELECT *, CASE WHEN depth IS NULL OR depth < 1e-4 THEN 'depth' WHEN conf < 1.3 THEN 'confidence' WHEN step > 1.5 THEN 'edge' END AS reject FROM steps)"


@query(REJECTS + " SELECT frame, r, c, reject FROM rejects")
def pixel_rejects(s, d):
    return grid.with_reject(pixels(s, d), 1.3, 1.5).select("frame", "r", "c", "reject")


@query(REJECTS + " SELECT frame, count(*) AS pixels, count(*) FILTER (reject = 'depth') AS depth, count(*) FILTER (reject = 'confidence') AS confidence, count(*) FILTER (reject = 'edge') AS edge, count(*) FILTER (reject IS NULL) AS kept FROM rejects GROUP BY 1")
def frame_contributions(s, d):
    return grid.contributions(grid.with_reject(pixels(s, d), 1.3, 1.5))


FLOORS = ", floors AS (SELECT frame, quantile_disc(conf, 0.2) AS percentile, least(greatest(1.05, quantile_disc(conf, 0.4)), quantile_disc(conf, 0.9)) AS middle, CASE WHEN count(*) FILTER (mask) >= 5 THEN quantile_disc(conf, 0.2) FILTER (mask) ELSE CAST('-inf' AS DOUBLE) END AS masked FROM pixels GROUP BY 1)"


@query(PIXELS + FLOORS + " SELECT * FROM floors")
def frame_confidence_floors(s, d):
    return grid.floors(pixels(s, d))


@query(PIXELS + ", b AS (SELECT frame, floor(conf * 20) AS bin, count(*) AS n FROM pixels GROUP BY 1, 2), k AS (SELECT frame, bin, sum(n) OVER (PARTITION BY frame ORDER BY bin) / sum(n) OVER (PARTITION BY frame) AS by_rank FROM b) SELECT p.frame, r, c, 1.0::DOUBLE AS by_none, round(by_rank, 9) AS by_rank, conf AS by_confidence FROM pixels p JOIN k ON k.frame = p.frame AND k.bin = floor(p.conf * 20)")
def confidence_ranks(s, d):
    return grid.confidence_ranks(pixels(s, d)).withColumn("by_rank", F.round("by_rank", 9))


@query(PIXELS + FLOORS + ", o AS (SELECT least(greatest(1.05, quantile_disc(conf, 0.4)), quantile_disc(conf, 0.9)) AS pooled FROM pixels) SELECT frame, count(*) FILTER (conf >= o.pooled) / count(*) AS pooled, count(*) FILTER (conf >= middle) / count(*) AS own, count(*) FILTER (conf >= o.pooled) / count(*) < 0.02 AS poor FROM pixels JOIN floors USING (frame), o GROUP BY 1")
def coverage_audit(s, d):
    p = pixels(s, d)
    return grid.coverage(p, grid.floors(p), "middle")


def cameras(s, d) -> DataFrame:
    """Frames look along y; every other one is pitched."""
    even = F.col("frame") % 2 == 0
    pose = {"r00": (1.0, 1.0), "r01": (0.0, 0.0), "r02": (0.0, 0.0), "r10": (0.0, 0.0), "r11": (0.6, 0.0), "r12": (-0.8, -1.0), "r20": (0.0, 0.0), "r21": (0.8, 1.0), "r22": (0.6, 0.0)}
    frames = pixels(s, d).select("frame").distinct()
    return frames.withColumns({k: F.when(even, a).otherwise(b) for k, (a, b) in pose.items()}).withColumns({"t0": F.col("frame") * 0.5 - 1, "t1": F.lit(0.5), "t2": F.lit(0.2)})


CAMERA = "((c - 20) * depth / 40 - (frame * 0.5::DOUBLE - 1)) AS p0, ((r - 20) * depth / 40 - 0.5::DOUBLE) AS p1, (depth - 0.2::DOUBLE) AS p2"
WORLD = ", camera AS (SELECT *, " + CAMERA + " FROM {rows}), world AS (SELECT *, p0 AS x, CASE WHEN frame % 2 = 0 THEN 0.6::DOUBLE * p1 + 0.8::DOUBLE * p2 ELSE p2 END AS y, CASE WHEN frame % 2 = 0 THEN -0.8::DOUBLE * p1 + 0.6::DOUBLE * p2 ELSE -p1 END AS z FROM camera)"


@query(PIXELS + WORLD.format(rows="pixels") + " SELECT frame, r, c, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM world")
def back_projection(s, d):
    w = grid.to_world(pixels(s, d), cameras(s, d), *LENS)
    return w.select("frame", "r", "c", *(F.round(a, 6).alias(a) for a in "xyz"))


# Stations on a polyline

LINE = ", line AS (SELECT unnest(range(0, 9)) AS ord), line2 AS (SELECT ord, -4.0::DOUBLE + ord AS x, 1.0::DOUBLE + ord % 2 * 0.3::DOUBLE AS y FROM line), pieces0 AS (SELECT ord, x AS ax, y AS ay, lead(x) OVER (ORDER BY ord) AS bx, lead(y) OVER (ORDER BY ord) AS by_ FROM line2), pieces1 AS (SELECT *, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS size FROM pieces0 WHERE bx IS NOT NULL), pieces AS (SELECT *, sum(size) OVER (ORDER BY ord) - size AS before FROM pieces1)"
#: Of rows with k, x and y.
STATIONS = ", free AS (SELECT p.*, s.*, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (size * size) AS f FROM {rows} p, pieces s), near AS (SELECT *, greatest(0, least(1, f)) AS t FROM free), far AS (SELECT *, round(sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by_ - ay)) ** 2), 9) AS distance FROM near), placed AS (SELECT * EXCLUDE (before), before + t * size AS along, CAST(sign((bx - ax) * (y - ay) - (by_ - ay) * (x - ax)) AS INT) AS side, (ord = 7 AND f > 1) OR (ord = 0 AND f < 0) AS past_end FROM far QUALIFY row_number() OVER (PARTITION BY k ORDER BY distance, ord) = 1)"


def line(s) -> DataFrame:
    k = F.col("id")
    return s.range(9).select(k.alias("ord"), (F.lit(-4.0) + k).alias("x"), (F.lit(1.0) + k % 2 * 0.3).alias("y"))


TRACKED = ", tracked AS (SELECT point_id AS k, point_id % 40 AS track, x * 20 AS x, 1 + y * 10 AS y FROM points)"


def tracked(s, d) -> DataFrame:
    lines = line(s).crossJoin(s.range(40).select(F.col("id").alias("track")))  # nine vertices for each of 40 tracks
    p = points_of_tracks(shim.points(s, d), 40).select("k", "track", (F.col("x") * 20).alias("x"), (1 + F.col("y") * 10).alias("y"))
    return grid.stations(p, lines, "track")


@query(LINE + TRACKED + STATIONS.format(rows="tracked") + " SELECT k, round(along, 6) AS along, round(distance, 6) AS distance, side, past_end FROM placed")
def polyline_stations(s, d):
    return tracked(s, d).select("k", F.round("along", 6).alias("along"), F.round("distance", 6).alias("distance"), "side", "past_end")


@query(LINE + TRACKED + STATIONS.format(rows="tracked") + ", g AS (SELECT track, avg(CASE WHEN side > 0 THEN 1.0 ELSE 0.0 END) AS left_share, quantile_disc(distance, 0.1) AS p10, quantile_disc(distance, 0.5) AS p50, quantile_disc(distance, 0.9) AS p90 FROM placed WHERE side <> 0 AND NOT past_end GROUP BY 1) SELECT track, round(left_share, 6) AS left_share, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90, CASE WHEN left_share >= 0.7 THEN 'left' WHEN left_share <= 1 - 0.7::DOUBLE THEN 'right' END AS band FROM g")
def band_choice(s, d):
    return grid.band_choice(tracked(s, d), "track").withColumns({c: F.round(c, 6) for c in ("left_share", "p10", "p50", "p90")})


FAULT = "CASE WHEN past_end THEN 'end' WHEN distance > 4 THEN 'band' WHEN side <> 1 THEN 'side' WHEN height > 3 THEN 'canopy' WHEN height < -3 * 0.2::DOUBLE THEN 'below' END"
KEPT = PIXELS + FLOORS + ", kept AS (SELECT pixels.*, row_number() OVER (ORDER BY frame, r, c) AS k FROM pixels JOIN floors USING (frame) WHERE mask AND conf >= masked AND depth IS NOT NULL)" + WORLD.format(rows="kept") + LINE + STATIONS.format(rows="world") + ", stationed AS (SELECT *, z AS height FROM placed)"


def stationed(s, d) -> DataFrame:
    p = pixels(s, d).where("mask AND depth IS NOT NULL")
    kept = p.join(grid.floors(pixels(s, d)).select("frame", "masked"), "frame").where("conf >= masked")
    world = grid.to_world(kept, cameras(s, d), *LENS).withColumns({"road": F.lit(0), "height": F.col("z")})
    return grid.stations(world, line(s).withColumn("road", F.lit(0)), "road")


@query(KEPT + f" SELECT coalesce({FAULT}, 'kept') AS fault, count(*) AS n FROM stationed GROUP BY 1")
def band_filters(s, d):
    fault = grid.band_faults(GRID["widest_m"], GRID["side"], GRID["tallest_m"], GRID["rmse"])
    return stationed(s, d).groupBy(F.coalesce(fault, F.lit("kept")).alias("fault")).agg(F.count("*").alias("n"))


CELLED = KEPT + f', celled AS (SELECT frame, r, c, along, distance, greatest(height, 0) AS height, least(greatest(floor(along / 4), 0), 1) AS "column", least(greatest(floor(distance / 4), 0), 0) AS row FROM stationed WHERE ({FAULT}) IS NULL)'


@query(CELLED + ' SELECT frame, r, c, CAST("column" AS BIGINT) AS "column", CAST(row AS BIGINT) AS row, round(height, 6) AS height FROM celled ORDER BY "column", along, distance')
def station_cells(s, d):
    fault = grid.band_faults(GRID["widest_m"], GRID["side"], GRID["tallest_m"], GRID["rmse"])
    at = grid.with_cell(stationed(s, d).where(fault.isNull()), GRID["size_m"], GRID["length_m"], GRID["widest_m"])
    return at.orderBy("column", "along", "distance").select("frame", "r", "c", "column", "row", F.round("height", 6).alias("height"))


CELL_SQL = ", g AS (SELECT cell, count(*) AS votes, quantile_disc(h50, 0.5) AS h50, quantile_disc(h90, 0.5) AS h90, quantile_disc(h95, 0.5) AS h95, max(h95) - min(h95) AS spread, CAST(sum(voxels) AS BIGINT) AS samples FROM fv GROUP BY 1) SELECT cell, votes, " + ", ".join(f"CASE WHEN votes >= 3 THEN round({c}, 6) END AS {c}" for c in ("h50", "h90", "h95", "spread")) + ", samples, CASE WHEN votes < 3 THEN 'too few votes' END AS reason FROM g"


@query(CELLED + ', gv AS (SELECT {\'c\': CAST("column" AS BIGINT), \'r\': CAST(row AS BIGINT)} AS cell, frame, {\'i\': floor(along / 0.1::DOUBLE), \'j\': floor(distance / 0.1::DOUBLE)} AS voxel, height FROM celled)' + VOTES.replace("FROM votes", "FROM gv") + CELL_SQL.replace("SELECT cell, votes", 'SELECT cell.c AS "column", cell.r AS row, votes'))
def grass_height_grid(s, d):
    g = grid.grass_grid(pixels(s, d).where("depth IS NOT NULL OR NOT mask"), cameras(s, d), line(s), LENS, **GRID)
    return g.select("cell.*", "votes", *(F.round(c, 6).alias(c) for c in ("h50", "h90", "h95", "spread")), "samples", "reason")


# Votes and evidence


@query(", v AS (SELECT cell, frame, voxel FROM votes WHERE voxel % 4 = 0), n AS (SELECT cell, frame FROM v GROUP BY 1, 2 HAVING count(DISTINCT voxel) >= 6), k AS (SELECT cell, count(*) AS f FROM n GROUP BY 1) SELECT DISTINCT cell, coalesce(f, 0) AS structure_frames FROM votes LEFT JOIN k USING (cell)")
def structure_votes(s, d):
    return grid.structure_votes(shim.votes(s, d).withColumn("structure", F.col("voxel") % 4 == 0), 6)


@query(VOTES + ", m AS (SELECT cell, quantile_disc(h95, 0.5) AS ch FROM fv GROUP BY 1 HAVING count(*) >= 3), e AS (SELECT cell, frame, abs(h95 - ch) AS off, voxels FROM fv JOIN m USING (cell)), p AS (SELECT cell, list(frame ORDER BY off, frame) AS a, list(frame ORDER BY -off, frame) AS b, list(frame ORDER BY voxels, frame) AS w FROM e GROUP BY 1), q AS (SELECT cell, list_concat([a[1], b[1], w[1]], a) AS l FROM p) SELECT cell, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], ' ') AS frames FROM q")
def evidence_frames(s, d):
    v = votes(s, d)
    return grid.evidence_frames(v, cells.cell_heights(v)).select("cell", F.array_join(F.transform("frames", lambda f: f.cast("string")), " ").alias("frames"))


@query(CELLED + ", n AS (SELECT \"column\" AS c0, frame, count(*) AS n, string_agg(r || '.' || c, ' ' ORDER BY r, c) AS pixels FROM celled GROUP BY 1, 2) SELECT CAST(c0 AS BIGINT) AS cell, frame, n, pixels FROM n")
def cell_provenance(s, d):
    fault = grid.band_faults(GRID["widest_m"], GRID["side"], GRID["tallest_m"], GRID["rmse"])
    at = grid.with_cell(stationed(s, d).where(fault.isNull()), GRID["size_m"], GRID["length_m"], GRID["widest_m"])
    listed = grid.provenance(at.withColumn("cell", F.col("column")))
    return listed.withColumn("pixels", F.array_join(F.transform("pixels", lambda p: F.concat_ws(".", p["r"].cast("string"), p["c"].cast("string"))), " "))


# Masks


@query(PIXELS + ", n AS (SELECT f.frame, a.r, b.c FROM (SELECT DISTINCT frame FROM pixels) f, (SELECT unnest(range(0, 25)) AS r) a, (SELECT unnest(range(0, 60)) AS c) b) SELECT n.frame, n.r, n.c, coalesce(mask, false) AS set FROM n LEFT JOIN pixels p ON p.frame = n.frame AND p.r = least(floor((n.r + 0.5) * 40 / 25), 39) AND p.c = least(floor((n.c + 0.5) * 40 / 60), 39)")
def mask_resample(s, d):
    return grid.resampled(pixels(s, d).select("frame", "r", "c", F.col("mask").alias("set")), (40, 40), (25, 60))


@query(PIXELS + " SELECT frame, r, c FROM pixels p WHERE NOT EXISTS (SELECT 1 FROM pixels q WHERE q.structure AND q.frame = p.frame AND abs(q.r - p.r) <= 2 AND abs(q.c - p.c) <= 2)")
def structure_margin(s, d):
    return grid.outside_margin(pixels(s, d), 2).select("frame", "r", "c")


@query("SELECT vec_id, (exp(e[1] * 20) + exp(e[3] * 20)) / (exp(e[1] * 20) + exp(e[2] * 20) + exp(e[3] * 20) + exp(e[4] * 20)) >= 0.5 AS structure FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def structure_mass(s, d):
    e = shim.table(s, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double") * 20).alias("mass"))
    return e.select("vec_id", grid.is_structure("mass", [0, 2]).alias("structure"))
