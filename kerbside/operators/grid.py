"""From depth pixels to heights in road cells: rejects, floors, back-projection, stations, cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.stats import counted, nearest_rank
from kerbside.operators.cells import cell_heights, frame_votes, voxel_minima

#: Least depth, pixels that a floor over a mask needs, and the bounds of the middle floor.
LEAST_DEPTH, LEAST_MASKED, LEAST_FLOOR = 1e-4, 5, 1.05
#: Bins of the confidence histogram in one unit.
BINS = 20


def step_along(by: list[str], line: str, at: str) -> Column:
    """The largest relative step of depth to the two neighbours (one apart) along a line of the frame."""
    o = Window.partitionBy(*by, line).orderBy(at)
    near = [F.when(F.abs(move(at).over(o) - F.col(at)) == 1, move("depth").over(o)) for move in (F.lag, F.lead)]
    return F.greatest(*(F.coalesce(F.abs(d - F.col("depth")) / F.col("depth"), F.lit(0.0)) for d in near))


def neighbour_step(by: list[str] = ["frame"]) -> Column:  # noqa: B006
    """The largest relative step of depth to the four neighbours (r and c one apart) in the frame."""
    return F.greatest(step_along(by, "r", "c"), step_along(by, "c", "r"))


def with_reject(pixels: DataFrame, least_confidence: float, most_step: float) -> DataFrame:
    """Pixels (frame, r, c, depth, conf) and the first test that each fails, null for a usable one."""
    sound = F.col("depth").isNotNull() & ~F.isnan("depth") & (F.col("depth") >= LEAST_DEPTH) & (F.col("depth") < float("inf"))
    reject = F.when(~sound, "depth").when(F.coalesce(F.col("conf") < least_confidence, F.lit(True)), "confidence").when(F.col("_step") > most_step, "edge")
    return pixels.withColumn("_step", neighbour_step()).withColumn("reject", reject).drop("_step")


def contributions(rejected: DataFrame) -> DataFrame:
    """Of each frame its pixels, those that each test takes away, and those kept."""
    each = [counted(F.col("reject") == r).alias(r) for r in ("depth", "confidence", "edge")]
    return rejected.groupBy("frame").agg(F.count("*").alias("pixels"), *each, counted(F.col("reject").isNull()).alias("kept"))


def floors(pixels: DataFrame, drop: float = 0.2) -> DataFrame:
    """Confidence floors of each frame: none, the percentile `drop` of all and of its masked pixels, and the
    middle one, between LEAST_FLOOR and the 90th percentile."""
    masked = F.when(F.col("mask"), F.col("conf"))
    p = pixels.withColumn("_m", masked).groupBy("frame").agg(nearest_rank("conf", drop).alias("p"), nearest_rank("conf", 0.4).alias("p40"), nearest_rank("conf", 0.9).alias("p90"), F.count("_m").alias("n"), nearest_rank("_m", drop).alias("m"))
    return p.select("frame", F.col("p").alias("percentile"), F.least(F.greatest(F.lit(LEAST_FLOOR), "p40"), "p90").alias("middle"), F.when(F.col("n") >= LEAST_MASKED, F.col("m")).otherwise(float("-inf")).alias("masked"))


def rank_bins(pixels: DataFrame) -> DataFrame:
    """(frame, bin, by_rank): of each bin of a frame's histogram of confidences the share of pixels in it or below."""
    bins = pixels.groupBy("frame", confidence_bin().alias("bin")).agg(F.count("*").alias("n"))
    o = Window.partitionBy("frame").orderBy("bin")
    return bins.select("frame", "bin", (F.sum("n").over(o.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy("frame"))).alias("by_rank"))


def confidence_bin() -> Column:
    return F.floor(F.col("conf") * BINS)


def with_weights(some: DataFrame, pixels: DataFrame) -> DataFrame:
    """Some of the pixels with their weights by three rules: 1, the share of all the frame's pixels in its histogram
    bin or below, and the confidence."""
    ranked = some.withColumn("bin", confidence_bin()).join(rank_bins(pixels), ["frame", "bin"]).drop("bin")
    return ranked.withColumns({"by_none": F.lit(1.0), "by_confidence": F.col("conf")})


def confidence_ranks(pixels: DataFrame) -> DataFrame:
    return with_weights(pixels, pixels).select("frame", "r", "c", "by_none", "by_rank", "by_confidence")


def coverage(pixels: DataFrame, floor: DataFrame, column: str, least: float = 0.02) -> DataFrame:
    """Shares of each frame's pixels above the pooled middle floor and above its own, and frames under `least`."""
    pooled = pixels.agg(nearest_rank("conf", 0.4).alias("p40"), nearest_rank("conf", 0.9).alias("p90"))
    whole = pooled.select(F.least(F.greatest(F.lit(LEAST_FLOOR), "p40"), "p90").alias("_pooled"))
    # One row, so this join only adds a constant.
    at = pixels.join(floor.select("frame", F.col(column).alias("_own")), "frame").crossJoin(F.broadcast(whole))
    shares = at.groupBy("frame").agg((counted(F.col("conf") >= F.col("_pooled")) / F.count("*")).alias("pooled"), (counted(F.col("conf") >= F.col("_own")) / F.count("*")).alias("own"))
    return shares.withColumn("poor", F.col("pooled") < least)


def to_world(pixels: DataFrame, cameras: DataFrame, fx: float, fy: float, cx: float, cy: float, by: list[str] = ["frame"]) -> DataFrame:  # noqa: B006
    """World coordinates R^T (K^-1 [c, r, 1] depth - t) of pixels, by cameras (frame, rotation rows r00..r22, t0..t2)."""
    d = F.col("depth")
    p = [(F.col("c") - cx) * d / fx - F.col("t0"), (F.col("r") - cy) * d / fy - F.col("t1"), d - F.col("t2")]
    out = {a: sum((F.col(f"r{k}{j}") * p[k] for k in range(1, 3)), F.col(f"r0{j}") * p[0]) for j, a in enumerate("xyz")}
    return pixels.join(cameras, by).withColumns(out).select(*pixels.columns, "x", "y", "z")


def stations(points: DataFrame, lines: DataFrame, key: str, within: float | None = None) -> DataFrame:
    """Points (x, y) beside their key's polyline (vertices key, ord, x, y): metres along it, distance from
    it, side (1 left, -1 right), and whether the nearest place is past an end.

    A polyline has a few hundred vertices at most, so it travels as one array with each point; of
    distances that are equal to a nanometre the earliest piece wins. A point of a key without a line of some
    length has no station and is left out. With `within`, so are points farther than that from their line; a
    point then meets only the pieces about it, by cells of the map that the pieces' boxes reach into.
    """
    o = Window.partitionBy(key).orderBy("ord")
    size = F.hypot(F.lead("x").over(o) - F.col("x"), F.lead("y").over(o) - F.col("y"))
    pieces = lines.select(key, "ord", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(o).alias("bx"), F.lead("y").over(o).alias("by"), size.alias("size")).where("size > 0")
    pieces = pieces.withColumns({"before": F.sum("size").over(o) - F.col("size"), "last": F.lead("ord").over(o).isNull(), "first": F.lag("ord").over(o).isNull()})
    whole = F.array_sort(F.collect_list(F.struct("ord", "ax", "ay", "bx", "by", "size", "before", "last", "first"))).alias("_line")
    cells, keys = [], [key]
    if within is not None:
        size_m = max(4 * within, 1e-6)
        for c, name in (("x", "_i"), ("y", "_j")):
            span = F.sequence(F.floor((F.least(f"a{c}", f"b{c}") - within) / size_m), F.floor((F.greatest(f"a{c}", f"b{c}") + within) / size_m))
            pieces = pieces.withColumn(name, F.explode(span))
            cells.append(F.floor(F.col(c) / size_m).alias(name))
        keys += ["_i", "_j"]
    listed = pieces.groupBy(*keys).agg(whole)

    def at(p: Column) -> Column:
        dx, dy = p["bx"] - p["ax"], p["by"] - p["ay"]
        free = ((F.col("x") - p["ax"]) * dx + (F.col("y") - p["ay"]) * dy) / (p["size"] * p["size"])
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), free))
        far = F.hypot(F.col("x") - p["ax"] - t * dx, F.col("y") - p["ay"] - t * dy)
        cross = dx * (F.col("y") - p["ay"]) - dy * (F.col("x") - p["ax"])
        return F.struct(F.round(far, 9).alias("distance"), p["ord"].alias("ord"), (p["before"] + t * p["size"]).alias("along"), F.signum(cross).cast("int").alias("side"), ((p["last"] & (free > 1)) | (p["first"] & (free < 0))).alias("past_end"))

    best = F.array_min(F.transform("_line", at))
    placed = points.select(*points.columns, *cells).join(listed, keys).withColumn("_b", best)
    if within is not None:
        placed = placed.where(F.col("_b.distance") <= within)
    return placed.select(*points.columns, "_b.along", "_b.distance", "_b.side", "_b.past_end")


def band_faults(widest_m: float, side: int, tallest_m: float, rmse: float) -> Column:
    """Why a point (distance, side, past_end, height) is not in the band; null for those that are."""
    return F.when(F.col("past_end"), "end").when(F.col("distance") > widest_m, "band").when(F.col("side") != side, "side").when(F.col("height") > tallest_m, "canopy").when(F.col("height") < -3 * rmse, "below")


def with_cell(points: DataFrame, size_m: float, length_m: float, widest_m: float) -> DataFrame:
    """The cell of each station: column along the road and row away from it; the last ones take what is on their edge."""
    place = lambda c, whole: F.least(F.greatest(F.floor(F.col(c) / size_m), F.lit(0)), F.lit(int(-(-whole // size_m)) - 1))
    return points.withColumns({"column": place("along", length_m), "row": place("distance", widest_m), "height": F.greatest("height", F.lit(0.0))})


def structure_votes(votes: DataFrame, least: int) -> DataFrame:
    """Of each cell, the frames in which at least so many of its voxels are structure."""
    seen = votes.where("structure").groupBy("cell", "frame").agg(F.count_distinct("voxel").alias("n"))
    return votes.select("cell").distinct().join(seen.where(F.col("n") >= least).groupBy("cell").agg(F.count("*").alias("structure_frames")), "cell", "left").withColumn("structure_frames", F.coalesce("structure_frames", F.lit(0)))


def evidence_frames(votes: DataFrame, cells: DataFrame, count: int = 3) -> DataFrame:
    """Frames that show a cell's height: best agreement, largest disagreement, weakest support, then the
    next best; each once, in that order."""
    off = F.abs(F.col("h95") - F.col("cell_h95"))
    v = votes.join(cells.select("cell", F.col("h95").alias("cell_h95")).where("cell_h95 IS NOT NULL"), "cell").withColumn("off", off)
    by = lambda *c: F.array_sort(F.collect_list(F.struct(*c, "frame")))
    g = v.groupBy("cell").agg(by("off").alias("a"), by((-F.col("off")).alias("o")).alias("d"), by("voxels").alias("w"))
    names = lambda c: F.transform(c, lambda s: s["frame"])
    picked = F.concat(F.slice(names("a"), 1, 1), F.slice(names("d"), 1, 1), F.slice(names("w"), 1, 1), names("a"))
    return g.select("cell", F.slice(F.array_distinct(picked), 1, count).alias("frames"))


def provenance(points: DataFrame) -> DataFrame:
    """The pixels behind each (cell, frame), in order."""
    return points.groupBy("cell", "frame").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("r", "c"))).alias("pixels"))


def band_choice(points: DataFrame, key: str, decisive: float = 0.7) -> DataFrame:
    """The side that holds a decisive share of a track's points, if one does, and its distances' percentiles."""
    left = F.avg(F.when(F.col("side") > 0, 1.0).otherwise(0.0))
    g = points.where("side <> 0 AND NOT past_end").groupBy(key).agg(left.alias("left_share"), *(nearest_rank("distance", p).alias(f"p{int(100 * p)}") for p in (0.1, 0.5, 0.9)))
    return g.withColumn("band", F.when(F.col("left_share") >= decisive, "left").when(F.col("left_share") <= 1 - decisive, "right"))


def resampled(mask: DataFrame, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """A mask (frame, r, c, set) of one size at another: each new pixel takes the nearest old one."""
    old = lambda k, n, m: F.least(F.floor((F.col(k) + 0.5) * n / m), F.lit(n - 1))
    new = mask.select("frame").distinct().select("frame", F.explode(F.sequence(F.lit(0), F.lit(to[0] - 1))).alias("r")).select("frame", "r", F.explode(F.sequence(F.lit(0), F.lit(to[1] - 1))).alias("c"))
    at = new.withColumns({"_r": old("r", size[0], to[0]), "_c": old("c", size[1], to[1])})
    return at.join(mask.select("frame", F.col("r").alias("_r"), F.col("c").alias("_c"), "set"), ["frame", "_r", "_c"], "left").select("frame", "r", "c", F.coalesce("set", F.lit(False)).alias("set"))


def outside_margin(pixels: DataFrame, reach: int) -> DataFrame:
    """Pixels with no structure within `reach` in either direction."""
    spread = F.sequence(F.lit(-reach), F.lit(reach))
    near = pixels.where("structure").withColumn("_r", F.explode(spread)).withColumn("_c", F.explode(spread)).select("frame", (F.col("r") + F.col("_r")).alias("r"), (F.col("c") + F.col("_c")).alias("c")).distinct()
    return pixels.join(near, ["frame", "r", "c"], "left_anti")


def is_structure(mass: str, classes: list[int], floor: float = 0.5) -> Column:
    """Whether the softmax of a pixel's class scores puts at least so much on the given classes."""
    top = F.array_max(mass)
    e = F.transform(mass, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return sum((F.element_at(e, k + 1) for k in classes), F.lit(0.0)) / total >= floor


def grass_grid(pixels: DataFrame, cameras: DataFrame, line: DataFrame, lens: tuple[float, float, float, float], size_m: float, length_m: float, widest_m: float, side: int, tallest_m: float, rmse: float, voxel_m: float) -> DataFrame:
    """Cell heights of one road from masked depth pixels: floors, world points, stations, band, cells,
    voxels, frame votes and their medians. The ground is z = 0, heights are z, the road lies in x and y."""
    floor = floors(pixels).select("frame", "masked")
    kept = pixels.where("mask").join(floor, "frame").where(F.col("conf") >= F.col("masked")).drop("masked")
    world = to_world(kept, cameras, *lens).withColumn("road", F.lit(0)).withColumn("height", F.col("z"))
    at = stations(world, line.withColumn("road", F.lit(0)), "road")
    inside = with_cell(at.where(band_faults(widest_m, side, tallest_m, rmse).isNull()), size_m, length_m, widest_m)
    voxel = F.struct(F.floor(F.col("along") / voxel_m).alias("i"), F.floor(F.col("distance") / voxel_m).alias("j"))
    return cell_heights(frame_votes(voxel_minima(inside.select(F.struct("column", "row").alias("cell"), "frame", voxel.alias("voxel"), "height"))))
