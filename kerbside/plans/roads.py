"""Road edges from tracks, places in the road's frame, bands and folds along paths, as named queries with their
DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside import shim
from kerbside.functions.stats import rounded
from kerbside.operators import roadframe
from kerbside.operators.cloud import points_of_tracks
from kerbside.plans.catalog import query

TRACKS = 12
#: The ground leans along x, and its normal is not a unit one.
NORMAL, OFFSET = (0.3, 2.0, 0.0), 0.4
_SIZE = sum(v * v for v in NORMAL) ** 0.5
N = [v / _SIZE for v in NORMAL]


def poses(s, d) -> DataFrame:
    p = points_of_tracks(shim.points(s, d), TRACKS)
    move = lambda c, k: F.col(c) + F.col("k") * k
    return p.select(F.col("track").alias("road"), F.col("k").alias("ord"), move("x", 0.01).alias("x"), F.when(F.col("k") % 29 != 0, F.col("y")).alias("y"), move("z", 0.004).alias("z"))


def grounds(s, d) -> DataFrame:
    roads = shim.points(s, d).select((F.col("point_id") % TRACKS).alias("road")).distinct()
    return roads.select("road", *(F.lit(v).alias(f"n{c}") for c, v in zip("xyz", NORMAL, strict=True)), F.lit(OFFSET).alias("offset"))


def _cross(a: str, b: str) -> tuple[str, str, str]:
    (ax, ay, az), (bx, by, bz) = ([f"{v}{c}" for c in "xyz"] for v in (a, b))
    return f"({ay} * {bz} - {az} * {by})", f"({az} * {bx} - {ax} * {bz})", f"({ax} * {by} - {ay} * {bx})"


def _unit(vector: tuple[str, str, str], name: str) -> str:
    size = "sqrt(" + " + ".join(f"{v} ** 2" for v in vector) + ")"
    return ", ".join(f"{v} / nullif({size}, 0) AS {name}{c}" for v, c in zip(vector, "xyz", strict=True))


_NORMAL = ", ".join(f"{v!r}::DOUBLE AS n{c}" for v, c in zip(N, "xyz", strict=True))
_H = " + ".join(f"{v!r}::DOUBLE * {c}" for v, c in zip(N, "xyz", strict=True)) + f" + {OFFSET / _SIZE!r}::DOUBLE"
EDGES = (
    f", ps AS (SELECT point_id % {TRACKS} AS road, point_id AS ord, x + point_id * 0.01::DOUBLE AS x, CASE WHEN point_id % 29 <> 0 THEN y END AS y, z + point_id * 0.004::DOUBLE AS z FROM points)"
    f", fl AS (SELECT road, row_number() OVER (PARTITION BY road ORDER BY ord) AS i, {', '.join(f'{c} - {v!r}::DOUBLE * ({_H}) AS {c}' for v, c in zip(N, 'xyz', strict=True))} FROM ps WHERE y IS NOT NULL)"
    ", kp AS (WITH RECURSIVE r AS (SELECT road, i, x, y, z, true AS kept FROM fl WHERE i = 1 UNION ALL SELECT road, i, CASE WHEN far THEN x ELSE px END, CASE WHEN far THEN y ELSE py END, CASE WHEN far THEN z ELSE pz END, far FROM (SELECT f.*, r.x AS px, r.y AS py, r.z AS pz, sqrt((f.x - r.x) ** 2 + (f.y - r.y) ** 2 + (f.z - r.z) ** 2) >= 0.5 AS far FROM r JOIN fl f ON f.road = r.road AND f.i = r.i + 1)) SELECT road, i, x, y, z FROM r WHERE kept)"
    ", kn AS (SELECT *, row_number() OVER w - 1 AS ord, count(*) OVER (PARTITION BY road) AS n, " + ", ".join(f"coalesce(lead({c}) OVER w, {c}) - coalesce(lag({c}) OVER w, {c}) AS w{c}" for c in "xyz") + f", {_NORMAL} FROM kp WINDOW w AS (PARTITION BY road ORDER BY i))"
    f", sd AS (SELECT *, {_unit(_cross('n', 'w'), 's')} FROM kn WHERE n >= 2), edges AS (SELECT road, ord, {', '.join(f'x + sx * 1.5::DOUBLE AS x'.replace('x', c) for c in 'xyz')}, {_NORMAL} FROM sd)"
)


@query(EDGES + " SELECT road, ord, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM edges")
def road_edges(s, d):
    return roadframe.edges(poses(s, d), grounds(s, d), 1.5).select("road", "ord", *(rounded(F.col(c), 6).alias(c) for c in "xyz"))




def places_sql(places: str) -> str:
    """Tables up to `world`, of the places `pl` (k, road, along, distance)."""
    return (
        EDGES
        + f", pl AS ({places})"
        + ", pc0 AS (SELECT *, " + ", ".join(f"lead({c}) OVER w AS q{c}" for c in "xyz") + " FROM edges WINDOW w AS (PARTITION BY road ORDER BY ord)), pc1 AS (SELECT *, sqrt((qx - x) ** 2 + (qy - y) ** 2 + (qz - z) ** 2) AS size, qx - x AS dx, qy - y AS dy, qz - z AS dz FROM pc0 WHERE qx IS NOT NULL)"
        + f", pc AS (SELECT *, sum(size) OVER w - size AS before, ord = max(ord) OVER (PARTITION BY road) AS last_, {_unit(_cross('d', 'n'), 'o')} FROM pc1 WHERE size > 0 WINDOW w AS (PARTITION BY road ORDER BY ord))"
        + ", wd AS (SELECT pl.*, x, y, z, dx, dy, dz, ox, oy, oz, size, before, row_number() OVER (PARTITION BY k ORDER BY ord) AS choice, greatest(0, along) AS s FROM pl JOIN pc ON pc.road = pl.road AND (greatest(0, along) <= before + size OR last_)), world AS (SELECT k, " + ", ".join(f"{c} + d{c} * least(1, (s - before) / size) + o{c} * distance AS {c}" for c in "xyz") + " FROM wd WHERE choice = 1)"
    )


PLACES = "SELECT c_custkey AS k, c_custkey % 12 AS road, c_custkey * 7 % 90 / 4.0::DOUBLE - 2 AS along, c_custkey % 9 / 4.0::DOUBLE AS distance FROM customer"


def placed(s, d) -> DataFrame:
    q = F.col("c_custkey")
    at = shim.table(s, d, "customer").select(q.alias("k"), (q % 12).alias("road"), (q * 7 % 90 / 4.0 - 2).alias("along"), (q % 9 / 4.0).alias("distance"))
    return roadframe.to_world(at, roadframe.edges(poses(s, d), grounds(s, d), 1.5), grounds(s, d))


@query(places_sql(PLACES) + " SELECT k, pl.road, pl.along, pl.distance, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM pl LEFT JOIN world USING (k)")
def road_to_world(s, d):
    return placed(s, d).select("k", "road", "along", "distance", *(rounded(F.col(c), 6).alias(c) for c in "xyz"))


CORNERS = "SELECT k * 4 + corner AS k, road, along + [-0.25, 0.25, 0.25, -0.25][corner + 1]::DOUBLE AS along, distance + [-0.25, -0.25, 0.25, 0.25][corner + 1]::DOUBLE AS distance FROM (" + PLACES + "), (SELECT unnest([0, 1, 2, 3]) AS corner)"


@query(places_sql(CORNERS) + " SELECT k // 4 AS k, CAST(k % 4 AS INT) AS corner, pl.road, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM pl LEFT JOIN world USING (k)")
def cell_corners(s, d):
    q = F.col("c_custkey")
    at = shim.table(s, d, "customer").select(q.alias("k"), (q % 12).alias("road"), (q * 7 % 90 / 4.0 - 2).alias("along_m"), (q % 9 / 4.0).alias("distance_m"))
    quads = roadframe.cell_quads(at, roadframe.edges(poses(s, d), grounds(s, d), 1.5), grounds(s, d), 0.5)
    return quads.select("k", "corner", "road", *(rounded(F.col(c), 6).alias(c) for c in "xyz"))


BAND = (
    EDGES
    + ", v0 AS (SELECT *, " + ", ".join(f"coalesce(lead({c}) OVER w, {c}) - coalesce(lag({c}) OVER w, {c}) AS w{c}" for c in "xyz") + ", coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS step FROM edges WINDOW w AS (PARTITION BY road ORDER BY ord))"
    + f", v1 AS (SELECT *, sum(step) OVER (PARTITION BY road ORDER BY ord) AS gone, {_unit(_cross('w', 'n'), 'o')} FROM v0), v2 AS (SELECT *, " + ", ".join(f"{c} + o{c} * 3 AS f{c}" for c in "xyz") + " FROM v1)"
    + ", v AS (SELECT *, " + ", ".join(f"lead({c}) OVER w AS q{c}, lead(f{c}) OVER w AS g{c}" for c in "xyz") + " FROM v2 WINDOW w AS (PARTITION BY road ORDER BY ord))"
    + ", rg AS (WITH RECURSIVE r AS (SELECT road, ord, 1 AS n, true AS rung FROM v WHERE ord = 0 UNION ALL SELECT v.road, v.ord, CASE WHEN v.gone >= r.n * 2 THEN r.n + 1 ELSE r.n END, v.gone >= r.n * 2 FROM r JOIN v ON v.road = r.road AND v.ord = r.ord + 1) SELECT road, ord FROM r WHERE rung)"
    + ", sg AS (SELECT road, 'near' AS kind, ord, x AS ax, y AS ay, z AS az, qx AS bx, qy AS by_, qz AS bz FROM v WHERE qx IS NOT NULL UNION ALL SELECT road, 'far', ord, fx, fy, fz, gx, gy, gz FROM v WHERE qx IS NOT NULL UNION ALL SELECT road, 'rung', ord, x, y, z, fx, fy, fz FROM v JOIN rg USING (road, ord))"
)


@query(BAND + " SELECT road, kind, ord, " + ", ".join(f"round({a}{c}{'_' if a + c == 'by' else ''}, 6) AS {a}{c}" for a in "ab" for c in "xyz") + " FROM sg")
def band_segments(s, d):
    found = roadframe.band_segments(roadframe.edges(poses(s, d), grounds(s, d), 1.5), grounds(s, d), 3.0, 2.0)
    return found.select("road", "kind", "ord", *(rounded(F.col(f"{a}{c}"), 6).alias(f"{a}{c}") for a in "ab" for c in "xyz"))

