"""Surfaces, heights over planes, class scores, fixes and scopes, as named queries with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside import shim
from kerbside.operators import documents, surfaces, telemetry
from kerbside.plans.catalog import query

PEAKS = surfaces.Peaks(bin_m=0.02, low=-0.5, high=0.6, apart=0.1, half_band=0.03, least_share=0.01, least_prominence=1.3, least_extent=0.02)
N, OFFSET = (0.36, 0.8, 0.48), 0.1


def _axes() -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Two directions across N: that of (1, 0, 0) x N, and N x it."""
    first = (0.0, -N[2], N[1])
    size = sum(v * v for v in first) ** 0.5
    a = tuple(v / size for v in first)
    b = (N[1] * a[2] - N[2] * a[1], N[2] * a[0] - N[0] * a[2], N[0] * a[1] - N[1] * a[0])
    length = sum(v * v for v in b) ** 0.5
    return a, tuple(v / length for v in b)


def clouds(s, d) -> DataFrame:
    return shim.points(s, d).withColumn("g", F.col("point_id") % 3).drop("w")


def planes(s, d) -> DataFrame:
    g = clouds(s, d).select("g").distinct()
    return g.select("g", *(F.lit(v).alias(f"n{c}") for c, v in zip("xyz", N, strict=True)), F.lit(OFFSET).alias("offset"), (F.col("g") * 0.01).alias("rmse"))


def _along(v: tuple[float, ...]) -> str:
    return " + ".join(f"{n!r}::DOUBLE * {c}" for n, c in zip(v, "xyz", strict=True))


HEIGHTS = f", c AS (SELECT point_id % 3 AS g, x * {N[0]} + y * {N[1]} + z * {N[2]} + {OFFSET} AS h, {_along(_axes()[0])} AS u, {_along(_axes()[1])} AS v FROM points)"


def _nmad(source: str, column: str, name: str) -> str:
    return f", m_{name} AS (SELECT g, bin, quantile_disc({column}, 0.5) AS m FROM {source} GROUP BY 1, 2), {name} AS (SELECT s.g, s.bin, quantile_disc(abs({column} - m), 0.5) * 1.4826 AS {name} FROM {source} s JOIN m_{name} n ON n.g = s.g AND n.bin = s.bin GROUP BY 1, 2)"


@query(
    HEIGHTS
    + f", i AS (SELECT * FROM c WHERE h >= {PEAKS.low} AND h < {PEAKS.high}), b AS (SELECT g, least(54, floor((h - {PEAKS.low}::DOUBLE) / {PEAKS.bin_m}::DOUBLE))::BIGINT AS bin, count(*) AS n FROM i GROUP BY 1, 2),"
    + " p AS (SELECT a.g, a.bin, a.n, coalesce(max(o.n) FILTER (o.bin < a.bin), 0) AS lower_, coalesce(max(o.n) FILTER (o.bin > a.bin), 0) AS upper_, quantile_disc(o.n, 0.5) AS mid FROM b a JOIN b o ON o.g = a.g AND o.bin <> a.bin AND abs(o.bin - a.bin) <= 5 GROUP BY 1, 2, 3),"
    + f" k AS (SELECT g, bin, n / greatest(1, mid) AS prominence, {PEAKS.low}::DOUBLE + (bin + 0.5) * {PEAKS.bin_m}::DOUBLE AS centre FROM p WHERE n > lower_ AND n >= upper_ AND n / greatest(1, mid) >= {PEAKS.least_prominence}),"
    + f" d AS (SELECT i.g, bin, prominence, h, u, v FROM i JOIN k ON k.g = i.g AND h >= centre - {PEAKS.half_band}::DOUBLE AND h < centre + {PEAKS.half_band}::DOUBLE)"
    + _nmad("d", "h", "thickness") + _nmad("d", "u", "wide") + _nmad("d", "v", "deep")
    + ", t AS (SELECT g, bin, any_value(prominence) AS prominence, count(*) AS points, quantile_disc(h, 0.5) AS height FROM d GROUP BY 1, 2), q AS (SELECT g, count(*) AS total FROM c GROUP BY 1)"
    + f", e AS (SELECT t.*, points / total AS share, thickness, least(wide, deep) AS extent FROM t JOIN q USING (g) JOIN thickness USING (g, bin) JOIN wide USING (g, bin) JOIN deep USING (g, bin) WHERE points / total >= {PEAKS.least_share} AND least(wide, deep) >= {PEAKS.least_extent})"
    + " SELECT g, row_number() OVER (PARTITION BY g ORDER BY points DESC, bin) AS rank, round(height, 9) AS height, points, share, round(thickness, 9) AS thickness, prominence, round(extent, 9) AS extent FROM e"
)
def level_surfaces(s, d):
    found = surfaces.levels(clouds(s, d), planes(s, d), "g", PEAKS)
    return found.withColumns({c: F.round(c, 9) for c in ("height", "thickness", "extent")})


@query(
    HEIGHTS
    + ", t AS (SELECT g, count(*) AS points, quantile_disc(h, 0.98) AS top, max(h) AS most FROM c GROUP BY 1), n AS (SELECT c.g, h FROM c JOIN t ON t.g = c.g AND h >= top - 0.1::DOUBLE AND h <= top + 0.1::DOUBLE), m AS (SELECT g, quantile_disc(h, 0.5) AS m, count(*) AS k FROM n GROUP BY 1), r AS (SELECT n.g, k, quantile_disc(abs(h - m), 0.5) * 1.4826 AS rough FROM n JOIN m USING (g) GROUP BY 1, 2),"
    + " f AS (SELECT t.*, k, CASE WHEN k >= 3 THEN rough END AS rough, points >= 160 AS enough FROM t JOIN r USING (g)) SELECT g, points, round(CASE WHEN enough THEN top END, 9) AS height, round(CASE WHEN enough THEN sqrt(coalesce(rough, 0) ** 2 + (g * 0.01) ** 2) END, 9) AS uncertainty, round(CASE WHEN enough THEN rough END, 9) AS roughness, CASE WHEN enough THEN k END AS top_points, round(CASE WHEN enough THEN most END, 9) AS tallest, CASE WHEN NOT enough THEN 'too few points' END AS failure FROM f"
)
def heights_over_planes(s, d):
    found = surfaces.object_heights(clouds(s, d).where("g < 3"), planes(s, d), "g", band=0.1, least=160)
    return found.withColumns({c: F.round(c, 9) for c in ("height", "uncertainty", "roughness", "tallest")})


SCORES = ", e AS (SELECT vec_id, list_transform(list_slice(embedding, 1, 6), lambda x: CAST(x AS DOUBLE) * 20) AS a, list_transform(list_slice(embedding, 7, 12), lambda x: abs(CAST(x AS DOUBLE))) AS q, list_transform(list_slice(embedding, 13, 15), lambda x: CAST(x AS DOUBLE) * 4) AS p FROM embeddings)"
MODELS = [("classes", "a", [0, 2], 0.5, "always"), ("queries", "q", [1, 4, 5], 0.45, "vote"), ("prompts", "p", [], 0.6, "band")]


def scores(s, d) -> DataFrame:
    part = lambda a, b, f: F.transform(F.slice("embedding", a, b - a + 1), lambda x: f(x.cast("double")))
    return shim.table(s, d, "embeddings").select("vec_id", part(1, 6, lambda x: x * 20).alias("a"), part(7, 12, F.abs).alias("q"), part(13, 15, lambda x: x * 4).alias("p"))


@query(SCORES + ", s AS (SELECT vec_id, (exp(a[1]) + exp(a[3])) / list_sum(list_transform(a, lambda x: exp(x))) >= 0.5 AS one, CASE WHEN list_sum(q) > 0 THEN (q[2] + q[5] + q[6]) / list_sum(q) ELSE 0 END >= 0.45 AS two, greatest(0, list_max(p)) >= 0.6 AS three FROM e) SELECT vec_id, one AS structure, two OR three AS vote_only, three AS band_only FROM s")
def structure_uses(s, d):
    return surfaces.structure_masks(scores(s, d), MODELS).select("vec_id", "structure", "vote_only", "band_only")


@query(SCORES + ", k AS (SELECT vec_id, list_position(a, list_max(a)) - 1 AS class, exp(list_max(a)) / list_sum(list_transform(a, lambda x: exp(x))) AS probability FROM e), w AS (SELECT *, class IN (1, 3, 4) AS wins FROM k) SELECT vec_id % 5 AS frame, count(*) AS total, count(*) FILTER (wins) AS grass_wins, count(*) FILTER (wins AND probability >= 0.5) AS kept, count(*) FILTER (wins AND NOT probability >= 0.5) AS dropped FROM w GROUP BY 1")
def grass_mask_counts(s, d):
    masked = surfaces.grass_mask(scores(s, d), "a", ["road", "grass", "sky", "grass", "grass", "other"])
    return surfaces.mask_counts(masked.withColumn("frame", F.col("vec_id") % 5), ["frame"])


@query("SELECT session_id, CASE min(CASE WHEN accuracy <= 10 THEN 2 WHEN accuracy <= 25 THEN 1 ELSE 0 END) WHEN 2 THEN 'good' WHEN 1 THEN 'degraded' ELSE 'unavailable' END AS quality FROM fixes WHERE event_id % 3 > 0 OR accuracy <= 20 GROUP BY 1")
def track_quality(s, d):
    f = shim.fixes(s, d).where("event_id % 3 > 0 OR accuracy <= 20").withColumn("o", F.struct("t", "event_id"))
    return documents.track(f, "session_id", "o").select("session_id", "quality")


@query("SELECT event_id, session_id, t FROM (SELECT *, max(t // 86400000000000) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM fixes) WHERE m IS NULL OR t // 86400000000000 > m")
def fixes_strictly_newer(s, d):
    """A receiver's clock of whole days."""
    f = shim.fixes(s, d).withColumns({"_t": F.col("t"), "t": F.expr("t div 86400000000000")})
    return telemetry.strictly_newer(f).select("event_id", "session_id", F.col("_t").alias("t"))


@query(", tr AS (SELECT l_suppkey AS run_id, l_partkey % 8 AS object_id, l_quantity AS height FROM lineitem), sc AS (SELECT s_suppkey AS run_id FROM supplier WHERE s_nationkey % 2 = 0), df AS (SELECT DISTINCT r_regionkey AS object_id, r_name AS code FROM region) SELECT d.object_id, d.code, t.run_id, count(*) AS n, avg(height) AS mean, max(height) - min(height) AS spread FROM tr t SEMI JOIN sc USING (run_id) JOIN df d ON d.object_id = t.object_id GROUP BY 1, 2, 3")
def clip_scope(s, d):
    """Trials of the runs of a clip (suppliers of even nations) against the objects' definitions (regions)."""
    trials = shim.table(s, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), (F.col("l_partkey") % 8).alias("object_id"), F.col("l_quantity").alias("height"))
    runs = shim.table(s, d, "supplier").where(F.col("s_nationkey") % 2 == 0).select(F.col("s_suppkey").alias("run_id"))
    objects = shim.table(s, d, "region").select(F.col("r_regionkey").alias("object_id"), F.col("r_name").alias("code"))
    return documents.scoped_trials(trials, runs, objects)
