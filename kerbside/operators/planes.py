"""Ground planes of point clouds by consensus: many candidates at once, each scored by all points.

A cloud is the rows of one key; any number of clouds is fitted together, and a cloud may be of any size. The
triples that propose planes come from a seeded sample of each cloud (the least hashes of its keys), from all of
it and from its lowest part. One aggregation over points and candidates scores them; the best of each pool
is refined twice by weighted least squares, each time one more aggregation. No step is bound to one task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import vectors
from kerbside.functions.stats import counted
from kerbside.operators.stages import cut

#: Rows of a table with one row a cloud (or candidate) up to which it is sent to the points' tasks.
BROADCAST_ROWS = 200_000
#: Depth under a plane from which a point lies below it, and the least determinant of a solved fit.
DEEP, LEAST_DET = 0.05, 1e-12
PLANE = ("nx", "ny", "nz", "offset")


class Gate(NamedTuple):
    """What a ground plane must be: degrees off `up`, half the band's thickness in metres, inliers, the share of
    points below it, the scale of that share in scores, and the least share of inliers. `pools` are the lowest
    parts of the sample that triples are drawn from."""

    most_tilt: float = 30.0
    band: float = 0.02
    trials: int = 2000
    seed: int = 1
    least_inliers: int = 100
    most_below: float = 0.15
    below_scale: float = 0.05
    least_share: float = 0.01
    pools: tuple[float, ...] = (1.0, 0.35)
    sample: int = 1000


def least_hashes(df: DataFrame, by: list[str], key: str, most: int, seed: int = 0) -> DataFrame:
    """`most` rows of each group by the least hashes of their keys: a sample that partitions do not change.

    Up to the session's windowGroupLimitThreshold (1,000) tasks keep no more than that of a group before
    the rows are dealt by group; more are first cut to so many in each of 64 parts of a group.
    """
    order = [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]
    if most > 1000:
        part = Window.partitionBy(*by, F.pmod(F.xxhash64(key), F.lit(64))).orderBy(*order)
        df = df.withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= most).drop("_k")
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once: what is built on them would else write them out again and again."""
    new = F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))
    return df.select(*(c for c in df.columns if c not in columns), new)


def height() -> Column:
    return F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") + F.col("offset")


def tilt() -> Column:
    """Degrees between a unit normal and the unit up axis; null without a plane."""
    cosine = F.col("nx") * F.col("ux") + F.col("ny") * F.col("uy") + F.col("nz") * F.col("uz")
    return F.when(F.col("nx").isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def quality(share: Column, tilt_deg: Column, below: Column, rmse: Column, gate: Gate) -> Column:
    """Support, less for tilt, for points below and for scatter within the band."""
    lean, under = tilt_deg / max(1.0, gate.most_tilt), below / max(1e-6, gate.below_scale)
    return F.log(F.greatest(F.lit(1e-6), share)) - 2 * lean * lean - 2 * under * under - rmse / max(1e-6, gate.band)


def clouds(points: DataFrame, by: str, up: tuple[float, float, float] | DataFrame) -> DataFrame:
    """A row for each cloud: its points, their weight, its unit up axis, and two axes across it."""
    found = points.groupBy(by).agg(F.count("*").alias("n"), F.sum("w").alias("weight"))
    if isinstance(up, DataFrame):
        found = found.join(up.select(by, "ux", "uy", "uz"), by)
    else:
        found = found.withColumns({c: F.lit(float(v)) for c, v in zip(("ux", "uy", "uz"), up, strict=True)})
    at = vectors.vector(F.col("ux"), F.col("uy"), F.col("uz"))
    found = found.withColumn("_a", F.struct(vectors.unit(at).alias("u"), vectors.across(at).alias("s")))
    axes = {"ux": "_a.u.x", "uy": "_a.u.y", "uz": "_a.u.z"} | {f"{n}{c}": f"_a.s.{part}.{c}" for n, part in (("a", "first"), ("b", "second")) for c in "xyz"}
    return found.select(by, "n", "weight", *(F.col(v).alias(k) for k, v in axes.items())).where(F.col("ux").isNotNull())


def sized(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def usable(points: DataFrame, by: str, key: str) -> DataFrame:
    """Points with a place; a missing weight weighs nothing."""
    sound = [F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf")) for c in "xyz"]  # NaN is not below infinity
    return points.where(sound[0] & sound[1] & sound[2]).select(by, F.col(key).alias("_key"), *"xyz", F.coalesce("w", F.lit(0.0)).alias("w"))


def candidates(points: DataFrame, by: str, cloud: DataFrame, gate: Gate) -> DataFrame:
    """Planes through triples of each cloud's sample that pass the gate of tilt: (by, pool, trial, plane, tilt_deg)."""
    some = least_hashes(points, [by], "_key", gate.sample, gate.seed).join(cloud.select(by, "ux", "uy", "uz"), by)
    rise = F.col("x") * F.col("ux") + F.col("y") * F.col("uy") + F.col("z") * F.col("uz")
    sample = some.groupBy(by, "ux", "uy", "uz").agg(F.array_sort(F.collect_list(F.struct(rise.alias("rise"), "_key", "x", "y", "z"))).alias("sample"))
    pools = sample.withColumn("pool", F.explode(F.array(*(F.lit(p) for p in dict.fromkeys(max(0.01, min(1.0, p)) for p in gate.pools)))))
    pools = pools.withColumn("size", F.greatest(F.lit(3), F.ceil(F.size("sample") * F.col("pool"))).cast("long")).where(F.size("sample") >= 3)
    drawn = pools.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(gate.trials - 1))))
    digits = F.md5(F.concat_ws(":", F.lit(str(gate.seed)), F.col("trial").cast("string")))
    pick = lambda k: F.shiftright(F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("long") * F.least(F.col("size"), F.size("sample")), 32)
    drawn = once(drawn, **{f"i{k}": pick(k) for k in range(3)}).where("i0 != i1 AND i1 != i2 AND i0 != i2")
    corner = lambda k: F.element_at("sample", (F.col(f"i{k}") + 1).cast("int"))
    drawn = once(drawn, **{f"{n}{c}": corner(k)[c] for k, n in enumerate("pqr") for c in "xyz"})
    side = lambda n: vectors.vector(*(F.col(f"{n}{c}") - F.col(f"p{c}") for c in "xyz"))
    drawn = once(drawn, _n=vectors.unit(vectors.cross(side("q"), side("r")))).where(F.col("_n").isNotNull())
    up = vectors.vector(F.col("ux"), F.col("uy"), F.col("uz"))
    drawn = once(drawn, _f=F.when(vectors.dot(F.col("_n"), up) < 0, -1.0).otherwise(1.0))
    drawn = once(drawn, **{f"n{c}": F.col("_n")[c] * F.col("_f") for c in "xyz"})
    drawn = once(drawn, offset=-(F.col("nx") * F.col("px") + F.col("ny") * F.col("py") + F.col("nz") * F.col("pz")), tilt_deg=tilt())
    return drawn.where(F.col("tilt_deg") <= gate.most_tilt).select(by, "pool", "trial", *PLANE, "tilt_deg")


def support(near: Column) -> dict[str, Column]:
    """What points say of planes: inliers, their weight and squared distances, and points below."""
    return {"count": counted(near), "inner": F.sum(F.when(near, F.col("w")).otherwise(0.0)), "squares": F.sum(F.when(near, F.col("h") * F.col("h")).otherwise(0.0)), "below": counted(F.col("h") < -DEEP)}


def refined(points: DataFrame, planes: DataFrame, keys: list[str], gate: Gate, gated: bool = True) -> DataFrame:
    """Planes (with their clouds' axes) moved to the weighted least squares of their inliers, as a height over
    the two axes across; a plane that would leave the gate, or cannot be solved, stays as it is."""
    axis = lambda a: F.col("x") * F.col(f"{a}x") + F.col("y") * F.col(f"{a}y") + F.col("z") * F.col(f"{a}z")
    rest = [F.first(c).alias(c) for c in planes.columns if c not in keys]
    at = points.join(planes, keys[0]).withColumn("h", height()).withColumn("_w", F.when((F.abs("h") <= gate.band) & (F.col("w") > 0), F.col("w")))
    at = at.withColumns({"_p": axis("a"), "_q": axis("b"), "_r": axis("u")})
    w, s, t, v = (F.col(c) for c in ("_w", "_p", "_q", "_r"))
    sums = {"s1": w, "ss": w * s * s, "tt": w * t * t, "st": w * s * t, "s0": w * s, "t0": w * t, "v0": w * v, "sv": w * s * v, "tv": w * t * v}
    normal = at.groupBy(*keys).agg(*rest, *(F.sum(e).alias(f"_{k}") for k, e in sums.items()), F.count("_w").alias("_n"))
    ss, tt, st, s0, t0, s1, sv, tv, v0 = (F.col(f"_{k}") for k in ("ss", "tt", "st", "s0", "t0", "s1", "sv", "tv", "v0"))

    def det(r: list[list[Column]]) -> Column:
        (a, b, c), (d, e, f), (g, h, i) = r
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    whole, right = [[ss, st, s0], [st, tt, t0], [s0, t0, s1]], [sv, tv, v0]
    now = once(normal, _det=det(whole))
    now = once(now, _det=F.when(F.abs("_det") >= LEAST_DET, F.col("_det")))
    part = lambda k: det([[right[i] if j == k else x for j, x in enumerate(row)] for i, row in enumerate(whole)]) / F.col("_det")
    now = once(now, _a=part(0), _b=part(1), _c=part(2))
    now = once(now, _m=vectors.unit(vectors.vector(*(F.col(f"u{c}") - F.col("_a") * F.col(f"a{c}") - F.col("_b") * F.col(f"b{c}") for c in "xyz"))))
    now = once(now, _along=F.col("_m.x") * F.col("ux") + F.col("_m.y") * F.col("uy") + F.col("_m.z") * F.col("uz"))
    there = F.col("_m").isNotNull() & (F.lit(gated) | (F.col("_n") >= 3))
    inside = (F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_along"))))) <= gate.most_tilt) if gated else F.lit(True)
    new = dict(zip(PLANE, (F.col("_m.x"), F.col("_m.y"), F.col("_m.z"), -F.col("_c") * F.col("_along")), strict=True))
    taken = once(now, _take=F.coalesce(there & inside, F.lit(False)), _refused=F.coalesce(there & ~inside, F.lit(False)))
    new |= {"clamped": F.col("clamped") | F.col("_refused")}
    return taken.select(*((F.when(F.col("_take"), new[c]).otherwise(F.col(c)) if c in PLANE else new.get(c, F.col(c))).alias(c) for c in planes.columns))


def judged(points: DataFrame, planes: DataFrame, keys: list[str], gate: Gate) -> DataFrame:
    """What the points say of finished planes: inliers, share, rmse, tilt, share below, quality."""
    rest = [F.first(c).alias(c) for c in planes.columns if c not in keys]
    told = points.join(planes, keys[0]).withColumn("h", height()).groupBy(*keys).agg(*rest, *(e.alias(k) for k, e in support(F.abs("h") <= gate.band).items()))
    share, below = F.col("count") / F.col("n"), F.col("below") / F.col("n")
    told = told.withColumns({"inliers": F.col("count"), "inlier_share": share, "rmse": F.sqrt(F.try_divide("squares", "count")), "tilt_deg": tilt(), "below_share": below, "elevation": -F.col("offset")})
    score = quality(F.col("inlier_share"), F.col("tilt_deg"), F.col("below_share"), F.coalesce("rmse", F.lit(0.0)), gate)
    return told.withColumn("quality", F.when(F.col("nx").isNotNull(), score))


def fit_pools(points: DataFrame, by: str, key: str, up: tuple[float, float, float] | DataFrame = (0.0, 1.0, 0.0), gate: Gate = Gate()) -> DataFrame:
    """The best plane of each cloud and pool, or why there is none (`failure`).

    Points come as (by, key, x, y, z, w); `up` is one axis or a table (by, ux, uy, uz). Equal scores go to the
    earlier trial. Points are read six times: stage them if they are dear.
    """
    points = usable(points, by, key)
    cloud = cut(clouds(points, by, up))
    rows = cloud.count() * len(gate.pools)
    drawn = candidates(points, by, cloud, gate)
    one = lambda c: F.first(c).alias(c)
    scored = points.join(sized(drawn, rows * gate.trials), by).withColumn("h", height()).groupBy(by, "pool", "trial").agg(*map(one, (*PLANE, "tilt_deg")), *(e.alias(k) for k, e in support(F.abs("h") <= gate.band).items()))
    scored = scored.where("count > 0").join(sized(cloud, rows), by)
    score = quality(F.col("inner") / F.greatest(F.lit(1e-9), "weight"), F.col("tilt_deg"), F.col("below") / F.col("n"), F.sqrt(F.try_divide("squares", "count")), gate)
    enough = F.col("count") >= gate.least_inliers
    best = scored.withColumn("score", score).groupBy(by, "pool").agg(F.count("*").alias("candidates"), F.max_by(F.struct(*PLANE), F.when(enough, F.struct("score", (-F.col("trial")).alias("t")))).alias("_p"))
    every = cloud.withColumn("pool", F.explode(F.array(*(F.lit(p) for p in dict.fromkeys(max(0.01, min(1.0, p)) for p in gate.pools)))))
    found = every.join(best, [by, "pool"], "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    found = found.select(*every.columns, "candidates", F.lit(False).alias("clamped"), *(F.col(f"_p.{c}").alias(c) for c in PLANE))
    keys = [by, "pool"]
    moved = refined(points, sized(found, rows), keys, gate)
    moved = refined(points, sized(moved, rows), keys, gate)
    told = judged(points, sized(moved, rows), keys, gate)
    none = F.col("nx").isNull()
    why = (
        F.when(F.col("n") < 3, "fewer than three points")
        .when(none & (F.col("candidates") == 0), "no plane within the tilt")
        .when(none, "no plane has enough inliers")
        .when(F.col("inliers") < gate.least_inliers, "too few inliers after refinement")
        .when(F.col("below_share") > gate.most_below, "too much of the cloud lies below")
    )
    return told.withColumn("failure", why).select(by, "pool", *PLANE, "inliers", "inlier_share", "rmse", "tilt_deg", "elevation", "below_share", "candidates", "clamped", "quality", "failure")


def fit_robust(points: DataFrame, by: str, key: str, up: tuple[float, float, float] | DataFrame = (0.0, 1.0, 0.0), gate: Gate = Gate()) -> DataFrame:
    """The better of each cloud's pools by quality, the larger of equals; a thin one is a failure too.

    A cloud without a plane has one row with the failures of its pools.
    """
    each = fit_pools(points, by, key, up, gate)
    rank = F.when(F.col("failure").isNull(), F.struct("quality", F.col("pool").alias("p")))
    fields = [c for c in each.columns if c not in (by, "failure")]
    said = F.concat(F.format_string("%d%%: ", F.round(F.col("pool") * 100).cast("int")), F.col("failure"))
    best = each.groupBy(by).agg(F.max_by(F.struct(*fields), rank).alias("_f"), F.array_join(F.reverse(F.array_sort(F.collect_list(F.when(F.col("failure").isNotNull(), F.struct("pool", said.alias("s")))))).getField("s"), " | ").alias("_why"))
    best = best.select(by, "_f.*", "_why")
    why = F.when(F.col("nx").isNull(), F.col("_why")).when(F.col("inlier_share") < gate.least_share, "too thin")
    return best.withColumn("failure", why).drop("_why")


def fit_twice(points: DataFrame, by: str, key: str, up: tuple[float, float, float] | DataFrame = (0.0, 1.0, 0.0), gate: Gate = Gate()) -> tuple[DataFrame, DataFrame]:
    """Planes of the whole pool, and planes fitted again within 10 degrees of those with the next seed."""
    gate = gate._replace(pools=(1.0,))
    first = fit_pools(points, by, key, up, gate)
    axes = first.where("failure IS NULL").select(by, F.col("nx").alias("ux"), F.col("ny").alias("uy"), F.col("nz").alias("uz"))
    return first, fit_pools(points, by, key, axes, gate._replace(most_tilt=min(gate.most_tilt, 10.0), seed=gate.seed + 1))


def fit_seeded(points: DataFrame, seeds: DataFrame, by: str, key: str, up: tuple[float, float, float] | DataFrame = (0.0, 1.0, 0.0), gate: Gate = Gate()) -> DataFrame:
    """Planes through places marked by hand (by, key, x, y, z), three or more a cloud, refined once on the
    points near them. No gate of tilt: a hand's choice stands."""
    points, marks = usable(points, by, key), usable(seeds.withColumn("w", F.lit(1.0)), by, key)
    cloud = cut(clouds(points, by, up))
    rows = cloud.count()
    marked = cloud.join(marks.groupBy(by).agg(F.count("*").alias("seeds")), by, "left").withColumns({"seeds": F.coalesce("seeds", F.lit(0)), "clamped": F.lit(False)})
    nothing = marked.withColumns({c: F.lit(None).cast("double") for c in PLANE})
    flat = nothing.withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(0.0), "offset": F.lit(0.0)})  # every mark counts
    through = refined(marks, sized(flat, rows), [by], gate._replace(band=0.0), gated=False)
    solved = (F.col("nx") != 0) | (F.col("ny") != 0) | (F.col("nz") != 0)
    through = through.withColumns({c: F.when(solved & (F.col("seeds") >= 3), F.col(c)) for c in PLANE})
    told = judged(points, sized(refined(points, sized(through, rows), [by], gate, gated=False), rows), [by], gate)
    why = F.when(F.col("seeds") < 3, "fewer than three seeds").when(F.col("nx").isNull(), "seeds in a line")
    return told.withColumn("failure", why).select(by, *PLANE, "inliers", "inlier_share", "rmse", "tilt_deg", "elevation", "below_share", "failure")
