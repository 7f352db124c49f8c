"""Grass heights along two roads of many columns, as named queries with their DuckDB SQL.

Every customer makes a frame of 12 by 12 pixels that looks down on a road from 20 m; the next frame of
the same road stands 3 m further on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside import shim
from kerbside.operators import roadside
from kerbside.plans.catalog import query

SIDE_PX = 12
#: Pixels that a task makes.
TASK_MADE = 1_000_000
LENS = (20.0, 20.0, 6.0, 6.0)
OPTIONS = roadside.Options(widest=6.0, cell=2.0, voxel=0.5, least_frames=2, least_voxels=2, tallest=2.0, canopy_extent=0.55, canopy_gap=0.45, slope_rise=0.2, structure_frames=2, side=1, drop_past_ends=True)
#: The tilted ground of road 1.
LEAN = 0.05


def pixels(s, d) -> DataFrame:
    side = F.sequence(F.lit(0), F.lit(SIDE_PX - 1))
    q, r, c = F.col("c_custkey"), F.col("r"), F.col("c")
    made_by = shim.table(s, d, "customer")
    # A small file makes many pixels: spread first, or a few tasks would hold them all when they are dealt.
    tasks = max(1, made_by.count() * SIDE_PX * SIDE_PX // TASK_MADE)
    frames = made_by.select("c_custkey", (q % 2).alias("road"), F.floor(q / 2).alias("frame")).repartition(tasks, "c_custkey")
    p = frames.withColumn("r", F.explode(side)).withColumn("c", F.explode(side))
    tall = (q * 7 + r * 5 + c * 3) % 13 * 0.05 + F.when((q % 50 == 0) & (c >= 6), 2.5).otherwise(0.0) + F.when((q % 2 == 1) & (r > 4), (r - 4) * 0.2).otherwise(0.0)
    return p.select("road", "frame", "r", "c", F.when((q + r * c) % 53 != 0, 20 - tall).alias("depth"), (1 + (q + 3 * r + c) % 10 / 10).alias("conf"), ((r * 12 + c + q) % 61 != 7).alias("grass"), ((q % 40 < 9) & (c >= 4) & (c <= 7)).alias("structure"))


def cameras(s, d) -> DataFrame:
    q = F.col("c_custkey")
    turn = {f"r{i}{j}": F.lit(float((i == j) * (-1 if i == 2 else 1))) for i in range(3) for j in range(3)}
    return shim.table(s, d, "customer").select((q % 2).alias("road"), F.floor(q / 2).alias("frame"), *(v.alias(k) for k, v in turn.items()), (-3.0 * F.floor(q / 2)).alias("t0"), F.lit(0.0).alias("t1"), F.lit(20.0).alias("t2"))


def edges(s, d) -> DataFrame:
    q = F.col("c_custkey")
    k = F.floor(q / 2)
    e = shim.table(s, d, "customer").where(k % 25 == 0).select((q % 2).alias("road"), k.alias("k"))
    return e.select("road", (F.col("k") / 25).cast("long").alias("ord"), (F.col("k") * 3.0 - 10).alias("x"), (F.lit(-2.0) + F.col("k") / 25 % 2 * 0.5).alias("y"), F.lit(0.0).alias("z"))


def grounds(s, d) -> DataFrame:
    size = (1 + LEAN * LEAN) ** 0.5
    roads = shim.table(s, d, "customer").select((F.col("c_custkey") % 2).alias("road")).distinct()
    lean = F.col("road") == 1
    return roads.select("road", F.lit(0.0).alias("nx"), F.when(lean, LEAN / size).otherwise(0.0).alias("ny"), F.when(lean, 1 / size).otherwise(1.0).alias("nz"), F.lit(0.01).alias("offset"), F.lit(0.05).alias("rmse"), F.lit(0.0).alias("ux"), F.lit(0.0).alias("uy"), F.lit(1.0).alias("uz"))


FRAMES = """, px AS (SELECT c_custkey % 2 AS road, c_custkey // 2 AS frame, r, c, CASE WHEN (c_custkey + r * c) % 53 <> 0 THEN 20 - ((c_custkey * 7 + r * 5 + c * 3) % 13 * 0.05::DOUBLE + CASE WHEN c_custkey % 50 = 0 AND c >= 6 THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN c_custkey % 2 = 1 AND r > 4 THEN (r - 4) * 0.2::DOUBLE ELSE 0 END) END AS depth,
 1 + (c_custkey + 3 * r + c) % 10 / 10::DOUBLE AS conf, (r * 12 + c + c_custkey) % 61 <> 7 AS grass, c_custkey % 40 < 9 AND c >= 4 AND c <= 7 AS structure FROM customer, (SELECT unnest(range(0, 12)) AS r), (SELECT unnest(range(0, 12)) AS c)),
er1 AS (SELECT *, count(*) FILTER (grass) OVER (PARTITION BY road, frame, r ORDER BY c RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5 AS h FROM px),
er2 AS (SELECT * EXCLUDE (h), count(*) FILTER (h) OVER (PARTITION BY road, frame, c ORDER BY r RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5 AS inner_ FROM er1)"""
STEPS = ", ".join(f"CASE WHEN abs({m}({at}) OVER {o} - {at}) = 1 THEN abs({m}(depth) OVER {o} - depth) / depth END" for at, o in (("c", "w"), ("r", "v")) for m in ("lag", "lead"))
SEEN = (
    FRAMES
    + f", st AS (SELECT *, coalesce(greatest({STEPS}), 0) AS step FROM er2 WINDOW w AS (PARTITION BY road, frame, r ORDER BY c), v AS (PARTITION BY road, frame, c ORDER BY r)),"
    + " fl AS (SELECT road, frame, CASE WHEN count(*) FILTER (inner_) >= 5 THEN quantile_disc(conf, 0.2) FILTER (inner_) END AS fg, CASE WHEN count(*) FILTER (structure) >= 5 THEN quantile_disc(conf, 0.2) FILTER (structure) END AS fs FROM st GROUP BY 1, 2),"
    + " ok AS (SELECT * FROM st JOIN fl USING (road, frame) WHERE depth >= 1e-4 AND step <= 0.05),"
    + " seen AS (SELECT road, frame, 'grass' AS kind, r, c, depth FROM ok WHERE inner_ AND (fg IS NULL OR conf >= fg) UNION ALL SELECT road, frame, 'structure', r, c, depth FROM ok WHERE structure AND (fs IS NULL OR conf >= fs))"
)
_LENGTH = (1 + LEAN * LEAN) ** 0.5
#: The axes across the grounds are (0, -nz, ny) and (1, 0, 0).
BAND = (
    SEEN
    + f", gr AS (SELECT road, CASE WHEN road = 1 THEN {LEAN / _LENGTH!r}::DOUBLE ELSE 0 END AS ny, CASE WHEN road = 1 THEN {1 / _LENGTH!r}::DOUBLE ELSE 1 END AS nz FROM (SELECT DISTINCT c_custkey % 2 AS road FROM customer)),"
    + " ed AS (SELECT road, ord, -y * nz AS x, px AS y FROM (SELECT c_custkey % 2 AS road, c_custkey // 2 // 25 AS ord, c_custkey // 2 * 3.0::DOUBLE - 10 AS px, -2.0::DOUBLE + c_custkey // 2 // 25 % 2 * 0.5::DOUBLE AS y FROM customer WHERE c_custkey // 2 % 25 = 0) JOIN gr USING (road)),"
    + " pc0 AS (SELECT road, ord, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM ed WINDOW w AS (PARTITION BY road ORDER BY ord)), pc1 AS (SELECT *, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS size FROM pc0 WHERE bx IS NOT NULL),"
    + " pc AS (SELECT *, sum(size) OVER (PARTITION BY road ORDER BY ord) - size AS before, max(ord) OVER (PARTITION BY road) = ord AS last_, min(ord) OVER (PARTITION BY road) = ord AS first_, sum(size) OVER (PARTITION BY road) AS length FROM pc1),"
    + " wo AS (SELECT seen.*, ny, nz, row_number() OVER () AS k, (c - 6) * depth / 20 + 3.0::DOUBLE * frame AS wx, (r - 6) * depth / 20 AS wy, 20 - depth AS wz FROM seen JOIN gr USING (road)),"
    + " hi AS (SELECT *, (ny * wy + nz * wz + 0.01::DOUBLE) / nz AS over_ FROM wo),"
    + f" hj AS (SELECT * EXCLUDE (over_), greatest(over_, 0) AS height, -nz * wy + ny * wz AS x, wx AS y, kind = 'grass' AND over_ > {OPTIONS.tallest} AS canopy FROM hi WHERE over_ >= -3 * 0.05::DOUBLE),"
    + " sf AS (SELECT h.road, frame, kind, k, height, canopy, x, y, ax, ay, bx, by_, size, ord, before, last_, first_, length, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (size * size) AS f FROM hj h JOIN pc USING (road)),"
    + " sg AS (SELECT *, greatest(0, least(1, f)) AS t FROM sf), sh AS (SELECT *, round(sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by_ - ay)) ** 2), 9) AS distance FROM sg),"
    + " si AS (SELECT * EXCLUDE (before), before + t * size AS along, sign((bx - ax) * (y - ay) - (by_ - ay) * (x - ax)) AS side, (last_ AND f > 1) OR (first_ AND f < 0) AS past FROM sh QUALIFY row_number() OVER (PARTITION BY k ORDER BY distance, ord) = 1),"
    + " ob AS (SELECT frame, kind, height, {'road': road, 'col': least(greatest(ceil(length / 2) - 1, 0), greatest(0, floor(along / 2)))::BIGINT, 'row': least(2, greatest(0, floor(distance / 2)))::BIGINT} AS cell, {'a': floor(along / 0.5), 'd': floor(distance / 0.5), 'h': floor(height / 0.5)} AS voxel FROM si WHERE NOT canopy AND distance <= 6 AND side = 1 AND NOT past)"
)
CELLS = (
    BAND
    + ", vx AS (SELECT cell, frame, voxel, min(height) AS height FROM ob WHERE kind = 'grass' GROUP BY ALL), vr AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY cell, frame) AS n, lead(height) OVER w - height AS gap FROM vx WINDOW w AS (PARTITION BY cell, frame ORDER BY height, voxel)),"
    + " vt AS (SELECT cell, frame, count(*) AS voxels, quantile_disc(height, 0.5) AS h50, quantile_disc(height, 0.9) AS h90, quantile_disc(height, 0.95) AS h95, coalesce(max(gap) FILTER (r <= n - ceil(n * 0.1)), 0) AS gap FROM vr GROUP BY 1, 2 HAVING count(*) >= 2),"
    + " to_ AS (SELECT cell, list_sort(list(DISTINCT frame))[1:3] AS frames_ FROM vx GROUP BY 1), tl AS (SELECT cell, count(*) AS frames, CAST(sum(voxels) AS BIGINT) AS samples, quantile_disc(h50, 0.5) AS h50, quantile_disc(h90, 0.5) AS h90, quantile_disc(h95, 0.5) AS h95, quantile_disc(gap, 0.5) AS gap, max(h95) - min(h95) AS spread FROM vt GROUP BY 1),"
    + " po AS (SELECT cell, voxel, min(height) AS height FROM vx SEMI JOIN vt USING (cell, frame) GROUP BY 1, 2), pg AS (SELECT cell, quantile_disc(height, 0.02) AS ground FROM po GROUP BY 1), pk AS (SELECT cell, ground, count(*) FILTER (height <= ground + 0.05::DOUBLE) AS contacts FROM po JOIN pg USING (cell) GROUP BY 1, 2),"
    + " ev0 AS (SELECT cell, frame, abs(vt.h95 - tl.h95) AS off, voxels FROM vt JOIN tl USING (cell) WHERE frames >= 2), ev1 AS (SELECT cell, list_concat([arg_min(frame, (off, frame)), arg_min(frame, (-off, frame)), arg_min(frame, (voxels, frame))], list(frame ORDER BY off, frame)[1:3]) AS l FROM ev0 GROUP BY 1), ev AS (SELECT cell, list_filter(l, lambda x, i: list_position(l, x) = i)[1:3] AS evidence FROM ev1),"
    + " sx AS (SELECT cell, count(*) AS sf FROM (SELECT cell, frame FROM ob WHERE kind = 'structure' GROUP BY 1, 2 HAVING count(DISTINCT voxel) >= 2) GROUP BY 1),"
    + " ce AS (SELECT to_.cell, coalesce(frames, 0) AS frames, coalesce(samples, 0) AS samples, coalesce(sf, 0) AS structure_frames, coalesce(evidence, frames_) AS evidence, coalesce(frames >= 2, false) AS known, ground, contacts, h50, h90, h95, gap, spread FROM to_ LEFT JOIN tl USING (cell) LEFT JOIN pk USING (cell) LEFT JOIN ev USING (cell) LEFT JOIN sx USING (cell)),"
    + " ck AS (SELECT cell, frames, samples, structure_frames, evidence, "
    + ", ".join(f"CASE WHEN known THEN {c} END AS {c}" for c in ("ground", "contacts", "h50", "h90", "h95", "gap", "spread"))
    + ", "
    + ", ".join(f"CASE WHEN known THEN greatest(0, h{p} - ground) END AS extent{p}" for p in (50, 90, 95))
    + f" FROM ce), cs AS (SELECT *, CASE WHEN frames < 2 THEN CASE WHEN frames > 0 THEN 'too few frames' ELSE 'too few samples' END WHEN structure_frames >= 2 THEN 'a structure stands here' WHEN extent95 > {OPTIONS.canopy_extent} THEN 'above the canopy''s extent' WHEN gap > {OPTIONS.canopy_gap} THEN 'floats above the ground' END AS why FROM ck),"
    + " ct AS (SELECT *, CASE WHEN why IS NULL THEN 'measured' WHEN why LIKE 'too few%' THEN 'abstained' WHEN why LIKE 'a structure%' THEN 'structure' ELSE 'canopy' END AS state FROM cs),"
    + " ft AS (SELECT cell, ground - lag(ground) OVER w > 0.2::DOUBLE AND lead(ground) OVER w - ground > 0.2::DOUBLE AS foot FROM ct WHERE ground IS NOT NULL AND state <> 'structure' WINDOW w AS (PARTITION BY cell.road, cell.col ORDER BY cell.row)), fo AS (SELECT cell.road AS froad, cell.col AS fcol, min(cell.row) AS frow FROM ft WHERE foot GROUP BY 1, 2),"
    + " ca AS (SELECT ct.*, coalesce(cell.row >= frow, false) AND state IN ('measured', 'canopy') AS beyond FROM ct LEFT JOIN fo ON froad = cell.road AND fcol = cell.col),"
    + " assessed AS (SELECT cell.road AS road, cell.col AS \"column\", cell.row AS \"row\", (cell.col + 0.5::DOUBLE) * 2 AS along_m, (cell.row + 0.5::DOUBLE) * 2 AS distance_m, ground, contacts, extent50, extent90, extent95, h50, h90, h95, frames, samples, spread, gap, structure_frames, CASE WHEN beyond THEN 'slope' ELSE state END AS status, CASE WHEN beyond THEN 'beyond the slope''s foot' ELSE why END AS reason, evidence FROM ca)"
)
EXACT = ("road", "column", "row", "along_m", "distance_m", "contacts", "frames", "samples", "structure_frames", "status", "reason")
MEASURED = ("ground", "extent50", "extent90", "extent95", "h50", "h90", "h95", "spread", "gap")
SHOWN = "array_to_string(evidence, ' ')"


def assessed(s, d) -> DataFrame:
    return roadside.assess(pixels(s, d), cameras(s, d), edges(s, d), grounds(s, d), LENS, OPTIONS)


def joined(numbers):
    return F.array_join(F.transform(numbers, lambda f: f.cast("string")), " ")


@query(CELLS + f" SELECT {', '.join(chr(34) + c + chr(34) for c in EXACT)}, {', '.join(f'round({c}, 6) AS {c}' for c in MEASURED)}, {SHOWN} AS evidence FROM assessed")
def roadside_cells(s, d):
    return assessed(s, d).select(*EXACT, *(F.round(c, 6).alias(c) for c in MEASURED), joined("evidence").alias("evidence"))


ORDERS = {"lowest": "extent95", "median": "abs(extent95 - middle)", "highest": "-extent95", "least supported": "frames, samples", "most disputed": "-coalesce(spread, 0)"}


@query(
    CELLS
    + ", k AS (SELECT road, quantile_disc(extent95, 0.5) AS middle FROM assessed WHERE status = 'measured' GROUP BY 1), g AS (SELECT road, count(*) AS cells, "
    + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ("measured", "abstained", "canopy", "slope", "structure"))
    + ", "
    + ", ".join(f"{m}({c}) FILTER (status = 'measured') AS {c}_{n}" for c in ("h95", "extent95") for m, n in (("min", "low"), ("max", "high")))
    + ", ["
    + ", ".join(f"{{'reason': '{r}', 'at': arg_min({{'c': \"column\", 'r': \"row\"}}, ({o}, \"column\", \"row\")) FILTER (status = 'measured')}}" for r, o in ORDERS.items())
    + ", {'reason': 'abstained', 'at': min({'c': \"column\", 'r': \"row\"}) FILTER (status = 'abstained')}] AS ps FROM assessed LEFT JOIN k USING (road) GROUP BY 1)"
    + " SELECT road, cells, measured, abstained, canopy, slope, structure, round(h95_low, 6) AS h95_low, round(h95_high, 6) AS h95_high, round(extent95_low, 6) AS extent95_low, round(extent95_high, 6) AS extent95_high, measured / cells::DOUBLE AS coverage, array_to_string(list_transform(list_filter(ps, lambda p, i: p.at IS NOT NULL AND list_position(list_transform(ps, lambda q: q.at), p.at) = i), lambda p: p.at.c || '/' || p.at.r || ' ' || p.reason), ', ') AS samples FROM g"
)
def roadside_summary(s, d):
    told = roadside.summary(assessed(s, d))
    listed = F.array_join(F.transform("samples", lambda p: F.concat(p["column"].cast("string"), F.lit("/"), p["row"].cast("string"), F.lit(" "), p["reason"])), ", ")
    return told.select("road", "cells", "measured", "abstained", "canopy", "slope", "structure", *(F.round(c, 6).alias(c) for c in ("h95_low", "h95_high", "extent95_low", "extent95_high")), "coverage", listed.alias("samples"))


@query(FRAMES + " SELECT road, frame, r, c, inner_ AS kept FROM er2 WHERE grass")
def mask_erosion(s, d):
    return roadside.eroded(pixels(s, d), "grass", 2, roadside.FRAME, "kept").where("grass").select("road", "frame", "r", "c", "kept")
