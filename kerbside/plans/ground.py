"""Ground planes as named queries, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside import shim
from kerbside.operators import planes
from kerbside.plans.catalog import query

#: The test clouds are balls, so the band is wide and much may lie below.
GATE = planes.Gate(most_tilt=40.0, band=0.04, trials=80, least_inliers=8, most_below=0.45, below_scale=0.4, sample=200)
COLUMNS = [*planes.PLANE, "inlier_share", "rmse", "tilt_deg", "elevation", "below_share", "quality"]
#: An up axis for each of the clouds.
UPS = ", ups AS (SELECT g, 0.1::DOUBLE * g AS ux, 1.0::DOUBLE AS uy, -0.05::DOUBLE * g AS uz FROM (SELECT DISTINCT w::BIGINT AS g FROM points))"


def clouds(s, d) -> DataFrame:
    return shim.points(s, d).withColumn("g", F.col("w").cast("long"))


def ups(s, d) -> DataFrame:
    return clouds(s, d).select("g").distinct().select("g", (F.col("g") * 0.1).alias("ux"), F.lit(1.0).alias("uy"), (F.col("g") * -0.05).alias("uz"))


def _unit(x: str, y: str, z: str, names: str) -> str:
    a, b, c = names.split()
    return f"({x}) / sqrt(({x}) ** 2 + ({y}) ** 2 + ({z}) ** 2) AS {a}, ({y}) / sqrt(({x}) ** 2 + ({y}) ** 2 + ({z}) ** 2) AS {b}, ({z}) / sqrt(({x}) ** 2 + ({y}) ** 2 + ({z}) ** 2) AS {c}"


TILT = "CASE WHEN nx IS NOT NULL THEN degrees(acos(greatest(-1, least(1, nx * ux + ny * uy + nz * uz)))) END"
H = "(nx * x + ny * y + nz * z + o)"


def _quality(share: str, tilt: str, below: str, rmse: str, gate: planes.Gate) -> str:
    return f"ln(greatest(1e-6, {share})) - 2 * ({tilt} / {gate.most_tilt}::DOUBLE) ** 2 - 2 * ({below} / {gate.below_scale}::DOUBLE) ** 2 - {rmse} / {gate.band}::DOUBLE"


def _det(*rows: str) -> str:
    (a, b, c), (d, e, f), (g, h, i) = (r.split() for r in rows)
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _refine(old: str, new: str, gate: planes.Gate) -> str:
    """One guarded refinement of the planes in `old`, as the tables r_`new` to `new`."""
    near = f"abs({H}) <= {gate.band}::DOUBLE AND w > 0"
    sums = {"s1": "w", "ss": "w * s * s", "tt": "w * t * t", "st": "w * s * t", "s0": "w * s", "t0": "w * t", "v0": "w * v", "sv": "w * s * v", "tv": "w * t * v"}
    whole = ("ss st s0", "st tt t0", "s0 t0 s1")
    solved = {"ca": _det("sv st s0", "tv tt t0", "v0 t0 s1"), "cb": _det("ss sv s0", "st tv t0", "s0 v0 s1"), "cc": _det("ss st sv", "st tt tv", "s0 t0 v0")}
    return (
        f", r_{new} AS (SELECT g, pool, {', '.join(f'sum({e}) AS {k}' for k, e in sums.items())} FROM (SELECT g, pool, w, x * ax + y * ay + z * az AS s, x * bx + y * by_ + z * bz AS t, x * ux + y * uy + z * uz AS v FROM pts JOIN {old} USING (g) WHERE {near}) GROUP BY 1, 2)"
        f", s_{new} AS (SELECT * FROM (SELECT g, pool, {', '.join(f'{v} / nullif({_det(*whole)}, 0) AS {k}' for k, v in solved.items())}, {_det(*whole)} AS d FROM r_{new}) WHERE abs(d) >= 1e-12)"
        f", t_{new} AS (SELECT g, pool, cc, {_unit('ux - ca * ax - cb * bx', 'uy - ca * ay - cb * by_', 'uz - ca * az - cb * bz', 'mx my mz')} FROM s_{new} JOIN axes USING (g))"
        f", u_{new} AS (SELECT o.*, t.cc, mx, my, mz, mx * ux + my * uy + mz * uz AS along FROM {old} o LEFT JOIN t_{new} t USING (g, pool))"
        f", {new} AS (SELECT * EXCLUDE (cc, mx, my, mz, along, ok, nx, ny, nz, o, clamped), CASE WHEN ok THEN mx ELSE nx END AS nx, CASE WHEN ok THEN my ELSE ny END AS ny, CASE WHEN ok THEN mz ELSE nz END AS nz, CASE WHEN ok THEN -cc * along ELSE o END AS o, clamped OR (mx IS NOT NULL AND NOT ok) AS clamped FROM (SELECT *, coalesce(degrees(acos(greatest(-1, least(1, along)))) <= {gate.most_tilt}, false) AS ok FROM u_{new}))"
    )


def fitted_sql(axes: str, gate: planes.Gate, before: str = "") -> str:
    """Tables up to `fits`, by cloud and pool; `axes` are the clouds' up axes (g, ux, uy, uz)."""
    least = [f"abs({c}) <= abs({a}) AND abs({c}) <= abs({b})" for c, a, b in (("ux", "uy", "uz"), ("uy", "uz", "uz"))]
    seed = [f"CASE WHEN {least[0]} THEN {i} WHEN abs(uy) <= abs(uz) AND NOT ({least[0]}) THEN {j} ELSE {k} END" for i, j, k in ((1, 0, 0), (0, 1, 0), (0, 0, 1))]
    pick = lambda k: f"('0x' || substr(md5('{gate.seed}:' || trial), {1 + 8 * k}, 8))::BIGINT * size // 4294967296"
    corners = ", ".join(f"sample[i{k} + 1].{c} AS {n}{c}" for k, n in enumerate("pqr") for c in "xyz")
    cross = "(qy - py) * (rz - pz) - (qz - pz) * (ry - py) AS cx, (qz - pz) * (rx - px) - (qx - px) * (rz - pz) AS cy, (qx - px) * (ry - py) - (qy - py) * (rx - px) AS cz"
    pools = ", ".join(f"{p}::DOUBLE" for p in gate.pools)
    band = f"abs(h) <= {gate.band}::DOUBLE"
    return (
        before
        + f", pts AS (SELECT w::BIGINT AS g, point_id AS k, x, y, z, w FROM points), up0 AS (SELECT g, {_unit('ux', 'uy', 'uz', 'ux uy uz')} FROM {axes})"
        + f", ax0 AS (SELECT *, {', '.join(f'{v} AS s{c}' for v, c in zip(seed, 'xyz', strict=True))} FROM up0), ax1 AS (SELECT *, {_unit('sy * uz - sz * uy', 'sz * ux - sx * uz', 'sx * uy - sy * ux', 'ax ay az')} FROM ax0)"
        + f", axes AS (SELECT *, {_unit('uy * az - uz * ay', 'uz * ax - ux * az', 'ux * ay - uy * ax', 'bx by_ bz')}, n, weight FROM ax1 JOIN (SELECT g, count(*) AS n, sum(w) AS weight FROM pts GROUP BY 1) USING (g))"
        + f", picked AS (SELECT g, list({{'rise': x * ux + y * uy + z * uz, 'k': k, 'x': x, 'y': y, 'z': z}} ORDER BY x * ux + y * uy + z * uz, k) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5('{gate.seed}:' || k), k) AS i FROM pts) JOIN axes USING (g) WHERE i <= {gate.sample} GROUP BY 1)"
        + f", pooled AS (SELECT g, sample, pool, least(len(sample), greatest(3, ceil(len(sample) * pool)))::BIGINT AS size FROM picked, (SELECT unnest([{pools}]) AS pool) WHERE len(sample) >= 3)"
        + f", drawn AS (SELECT * FROM (SELECT *, {', '.join(f'{pick(k)} AS i{k}' for k in range(3))} FROM pooled, (SELECT unnest(range({gate.trials})) AS trial)) WHERE i0 <> i1 AND i1 <> i2 AND i0 <> i2)"
        + f", crossed AS (SELECT g, pool, trial, px, py, pz, {cross} FROM (SELECT g, pool, trial, {corners} FROM drawn))"
        + ", faced AS (SELECT c.*, CASE WHEN cx * ux + cy * uy + cz * uz < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END / sqrt(cx * cx + cy * cy + cz * cz) AS f FROM crossed c JOIN axes USING (g) WHERE sqrt(cx * cx + cy * cy + cz * cz) > 1e-12)"
        + f", cands AS (SELECT *, -(nx * px + ny * py + nz * pz) AS o, {TILT} AS tilt FROM (SELECT g, pool, trial, px, py, pz, ux, uy, uz, cx * f AS nx, cy * f AS ny, cz * f AS nz FROM faced JOIN axes USING (g)) WHERE {TILT} <= {gate.most_tilt})"
        + f", sco AS (SELECT g, pool, trial, any_value(nx) AS nx, any_value(ny) AS ny, any_value(nz) AS nz, any_value(o) AS o, any_value(tilt) AS tilt, count(*) FILTER ({band}) AS c, sum(w) FILTER ({band}) AS inner_, sum(h * h) FILTER ({band}) AS q, count(*) FILTER (h < -0.05::DOUBLE) AS below FROM (SELECT *, {H} AS h FROM pts JOIN cands USING (g)) GROUP BY 1, 2, 3 HAVING c > 0)"
        + f", ranked AS (SELECT *, {_quality('inner_ / weight', 'tilt', '(below / n)', 'sqrt(q / c)', gate)} AS score FROM sco JOIN (SELECT g, n, weight FROM axes) USING (g))"
        + f", best AS (SELECT g, pool, count(*) AS candidates, arg_max({{'nx': nx, 'ny': ny, 'nz': nz, 'o': o}}, (score, -trial)) FILTER (c >= {gate.least_inliers}) AS p FROM ranked GROUP BY 1, 2)"
        + f", p0 AS (SELECT a.*, e.pool, coalesce(candidates, 0) AS candidates, false AS clamped, p.nx AS nx, p.ny AS ny, p.nz AS nz, p.o AS o FROM axes a CROSS JOIN (SELECT unnest([{pools}]) AS pool) e LEFT JOIN best b ON b.g = a.g AND b.pool = e.pool)"
        + _refine("p0", "p1", gate)
        + _refine("p1", "p2", gate)
        + f", told AS (SELECT g, pool, count(*) FILTER ({band}) AS inliers, count(*) FILTER ({band}) / count(*) AS inlier_share, sqrt(avg(h * h) FILTER ({band})) AS rmse, count(*) FILTER (h < -0.05::DOUBLE) / count(*) AS below_share FROM (SELECT g, pool, {H} AS h FROM pts JOIN p2 USING (g)) GROUP BY 1, 2)"
        + f", fit0 AS (SELECT p2.*, t.inliers, inlier_share, rmse, below_share, {TILT} AS tilt_deg, -o AS elevation, CASE WHEN nx IS NOT NULL THEN {_quality('inlier_share', '(' + TILT + ')', 'below_share', 'coalesce(rmse, 0)', gate)} END AS quality FROM p2 JOIN told t USING (g, pool))"
        + f", fits AS (SELECT *, CASE WHEN n < 3 THEN 'fewer than three points' WHEN nx IS NULL AND candidates = 0 THEN 'no plane within the tilt' WHEN nx IS NULL THEN 'no plane has enough inliers' WHEN inliers < {gate.least_inliers} THEN 'too few inliers after refinement' WHEN below_share > {gate.most_below} THEN 'too much of the cloud lies below' END AS failure FROM fit0)"
    )


TOLD = "nx, ny, nz, o AS offset, inlier_share, rmse, tilt_deg, elevation, below_share, quality"
ROUNDED = ", ".join(f"round({c.replace('offset', 'o')}, 6) AS \"{c}\"" for c in COLUMNS)


@query(fitted_sql("ups", GATE, UPS) + f" SELECT g, pool, {ROUNDED}, inliers, candidates, clamped, failure FROM fits")
def ground_pools(s, d):
    found = planes.fit_pools(clouds(s, d), "g", "point_id", ups(s, d), GATE)
    return found.select("g", "pool", *(F.round(c, 6).alias(c) for c in COLUMNS), "inliers", "candidates", "clamped", "failure")


@query(
    fitted_sql("ups", GATE, UPS)
    + ", f AS (SELECT g, arg_max(fits, (quality, pool)) FILTER (failure IS NULL) AS f, string_agg(round(pool * 100)::INT || '%: ' || failure, ' | ' ORDER BY pool DESC) AS why FROM fits GROUP BY 1)"
    + ", b AS (SELECT g, f.pool AS pool, " + ", ".join(f"f.{c} AS {c}" for c in ("nx", "ny", "nz", "o", "inlier_share", "rmse", "tilt_deg", "elevation", "below_share", "quality", "inliers")) + f", CASE WHEN f IS NULL THEN why WHEN f.inlier_share < {GATE.least_share} THEN 'too thin' END AS failure FROM f)"
    + f" SELECT g, pool, {ROUNDED}, inliers, failure FROM b"
)
def ground_plane(s, d):
    found = planes.fit_robust(clouds(s, d), "g", "point_id", ups(s, d), GATE)
    return found.select("g", "pool", *(F.round(c, 6).alias(c) for c in COLUMNS), "inliers", "failure")


PLAIN = planes.Gate(most_tilt=35.0, band=0.05, trials=50, seed=4, least_inliers=8, most_below=0.6, below_scale=0.3, pools=(1.0,), sample=120)


@query(fitted_sql("level", PLAIN, ", level AS (SELECT DISTINCT w::BIGINT AS g, 0.0::DOUBLE AS ux, 1.0::DOUBLE AS uy, 0.0::DOUBLE AS uz FROM points)") + f" SELECT g, {ROUNDED}, inliers, candidates, failure FROM fits")
def ransac_plane(s, d):
    found = planes.fit_pools(clouds(s, d), "g", "point_id", gate=PLAIN)
    return found.select("g", *(F.round(c, 6).alias(c) for c in COLUMNS), "inliers", "candidates", "failure")


ONE = GATE._replace(pools=(1.0,))
NEXT = ONE._replace(most_tilt=10.0, seed=ONE.seed + 1)
FIRST = fitted_sql("ups", ONE, UPS)


@query(f", firsts AS (SELECT * FROM ({FIRST.replace(', ups AS', 'WITH ups AS', 1)} SELECT g, nx AS ux, ny AS uy, nz AS uz, failure FROM fits) WHERE failure IS NULL)" + fitted_sql("firsts", NEXT) + f" SELECT g, {ROUNDED}, inliers, clamped, failure FROM fits")
def ground_two_pass(s, d):
    _, again = planes.fit_twice(clouds(s, d), "g", "point_id", ups(s, d), GATE)
    return again.select("g", *(F.round(c, 6).alias(c) for c in COLUMNS), "inliers", "clamped", "failure")


SEEDED = GATE._replace(least_inliers=3)
MARKS = ", marks AS (SELECT w::BIGINT AS g, point_id, x, y, z FROM points WHERE point_id % 17 < 3)"


def marks(s, d) -> DataFrame:
    return clouds(s, d).where("point_id % 17 < 3").select("g", "point_id", "x", "y", "z")


def _seeded_sql() -> str:
    """The first planes are least squares of the marks, in the axes of the clouds."""
    tables = fitted_sql("ups", SEEDED, UPS + MARKS)
    flat = ", p0 AS (SELECT a.*, 1.0::DOUBLE AS pool, 0 AS candidates, false AS clamped, 0.0::DOUBLE AS nx, 0.0::DOUBLE AS ny, 0.0::DOUBLE AS nz, 0.0::DOUBLE AS o FROM axes a)"
    free = SEEDED._replace(most_tilt=181.0)
    by_marks = _refine("p0", "p1", free).replace("FROM pts JOIN", "FROM (SELECT *, 1.0::DOUBLE AS w FROM marks) JOIN")
    counted = ", m AS (SELECT g, count(*) AS seeds FROM marks GROUP BY 1), p1b AS (SELECT * EXCLUDE (nx, ny, nz, o), " + ", ".join(f"CASE WHEN seeds >= 3 AND (nx <> 0 OR ny <> 0 OR nz <> 0) THEN {c} END AS {c}" for c in ("nx", "ny", "nz", "o")) + " FROM (SELECT p1.*, coalesce(seeds, 0) AS seeds FROM p1 LEFT JOIN m USING (g)))"
    rest = tables[tables.index(", told AS") :]
    return tables[: tables.index(", picked AS")] + flat + by_marks + counted + _refine("p1b", "p2", free) + rest


@query(_seeded_sql() + f" SELECT g, {ROUNDED.rpartition(', round(')[0]}, inliers, CASE WHEN seeds < 3 THEN 'fewer than three seeds' WHEN nx IS NULL THEN 'seeds in a line' END AS failure FROM fits")
def ground_by_hand(s, d):
    found = planes.fit_seeded(clouds(s, d), marks(s, d), "g", "point_id", ups(s, d), SEEDED)
    return found.select("g", *(F.round(c, 6).alias(c) for c in COLUMNS if c != "quality"), "inliers", "failure")
