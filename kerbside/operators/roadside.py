"""Grass heights along many roads at once: from masks and depth to cells with a status and their evidence.

The stages are joined by keys that are structs of road, column and row, so roads of any length keep their
cells apart. A frame's pixels are dealt once, by (road, frame); erosion, depth steps and confidence floors
then work within tasks. Cells are dealt by cell. No stage holds more than a frame or a cell's votes together.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import vectors
from kerbside.functions.stats import counted, finite, nearest_rank, share
from kerbside.operators import cells, grid
from kerbside.operators.stages import cut

FRAME = ["road", "frame"]
#: Pixels that a task sorts.
TASK_PIXELS = 100_000


class Options(NamedTuple):
    """Metres, unless it says otherwise. `side` is 0 for both sides; an infinite limit switches a stage off."""

    widest: float = 6.0
    cell: float = 0.5
    voxel: float = 0.05
    least_frames: int = 3
    least_voxels: int = 20
    tallest: float = float("inf")
    canopy_extent: float = float("inf")
    canopy_gap: float = float("inf")
    slope_rise: float = float("inf")
    structure_frames: float = float("inf")
    side: int = 0
    drop_past_ends: bool = False
    own_datum: bool = False
    erosion: int = 2
    confidence_drop: float = 0.2
    most_step: float = 0.05


def dealt(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Pixels dealt by frame to tasks of about TASK_PIXELS. Adaptive execution would put partitions together by
    their compressed bytes, of which a pixel has few, and a task's sorts would grow with the table."""
    return pixels.repartition(max(1, math.ceil(pixels.count() / TASK_PIXELS)), *by)


def eroded(pixels: DataFrame, mask: str, radius: int, by: list[str], into: str, step: str | None = None) -> DataFrame:
    """Pixels (by, r, c, mask) and whether the whole square about each is set: counts along rows, then of
    whole rows along columns. What is not there counts as not set, so masks lose their outer rim. Under the
    name `step`, the largest relative step of depth to a neighbour comes from the same two sorts."""
    whole = 2 * radius + 1
    along = lambda line, order: Window.partitionBy(*by, line).orderBy(order).rangeBetween(-radius, radius)
    steps = lambda line, order: {f"_{line}": grid.step_along(by, line, order)} if step else {}
    rows = dealt(pixels, by).withColumns({"_h": F.sum(F.when(F.col(mask), 1).otherwise(0)).over(along("r", "c")) == whole, **steps("r", "c")})
    both = rows.withColumns({into: F.sum(F.when(F.col("_h"), 1).otherwise(0)).over(along("c", "r")) == whole, **steps("c", "r")})
    return (both.withColumn(step, F.greatest("_r", "_c")) if step else both).drop("_h", "_r", "_c")


def observed(pixels: DataFrame, o: Options) -> DataFrame:
    """Usable pixels of each kind (grass, structure): of sound depth, no edge, and above their kind's floor
    of confidence in the frame. Pixels without a confidence pass only where there is no floor."""
    masks = {"grass": F.col("_grass"), "structure": F.col("structure")}
    marked = eroded(pixels, "grass", o.erosion, FRAME, "_grass", "_step").where(masks["grass"] | masks["structure"])
    # Floors and pixels come from one table, so the frames are sorted once.
    marked = dealt(cut(marked.select(*FRAME, "r", "c", "depth", "_step", "_grass", "structure", finite(F.col("conf")).alias("conf"))), FRAME)
    conf = F.col("conf")
    of_kind = marked.select(*FRAME, *(F.when(m, conf).alias(f"_conf_{k}") for k, m in masks.items()))
    floors = of_kind.groupBy(*FRAME).agg(*(F.when(F.count(f"_conf_{k}") >= grid.LEAST_MASKED, nearest_rank(f"_conf_{k}", o.confidence_drop)).alias(f"_floor_{k}") for k in masks))
    sound = F.col("depth").isNotNull() & (F.col("depth") >= grid.LEAST_DEPTH) & (F.col("depth") < float("inf")) & (F.col("_step") <= o.most_step)
    each = F.array_compact(F.array(*(F.when(m & (F.col(f"_floor_{k}").isNull() | (conf >= F.col(f"_floor_{k}"))), F.lit(k)) for k, m in masks.items())))
    return marked.where(sound).join(floors, FRAME).select(*FRAME, F.explode(each).alias("kind"), "r", "c", "depth")


def frames_of_roads(edges: DataFrame, grounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A road's ground (its plane, the axes across it, how upright it is), and its edge in those axes with its
    length. Grounds: road, nx, ny, nz, offset, rmse, ux, uy, uz; edges: road, ord, x, y, z. A ground that is
    edge-on to the up axis has no heights and drops its road."""
    n, up = vectors.vector(*(F.col(f"n{c}") for c in "xyz")), vectors.vector(*(F.col(f"u{c}") for c in "xyz"))
    g = grounds.withColumn("_a", F.struct(vectors.across(n).alias("s"), vectors.dot(vectors.unit(n), vectors.unit(up)).alias("upright")))
    g = g.select("road", "nx", "ny", "nz", "offset", "rmse", F.col("_a.upright").alias("upright"), *(F.col(f"_a.s.{k}.{c}").alias(f"{a}{c}") for a, k in (("a", "first"), ("b", "second")) for c in "xyz")).where("upright > 1e-6")
    flat = edges.join(g, "road").select("road", "ord", _along("a").alias("x"), _along("b").alias("y"))
    o = Window.partitionBy("road").orderBy("ord")
    size = F.hypot(F.col("x") - F.lag("x").over(o), F.col("y") - F.lag("y").over(o))
    length = flat.withColumn("_s", size).groupBy("road").agg(F.sum("_s").alias("length"))
    return cut(g.join(length, "road").where("length > 0")), flat


def _along(axis: str) -> Column:
    return F.col("x") * F.col(f"{axis}x") + F.col("y") * F.col(f"{axis}y") + F.col("z") * F.col(f"{axis}z")


def placed(seen: DataFrame, cameras: DataFrame, edges: DataFrame, grounds: DataFrame, lens: tuple[float, float, float, float], o: Options) -> DataFrame:
    """Observations in the band: kind, frame, cell, voxel, height, pixel and whether it is too tall to be grass.

    Cameras: road, frame, rotation rows r00..r22, t0..t2. Heights are upright ones over the plane, below
    it by three times its rmse at most, and never less than 0.
    """
    ground, flat = frames_of_roads(edges, grounds)
    world = grid.to_world(seen, cameras, *lens, by=FRAME).join(F.broadcast(ground) if ground_is_small(ground) else ground, "road")
    over = (F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") + F.col("offset")) / F.col("upright")
    tall = world.withColumn("height", over).where(F.col("height") >= -3 * F.abs("rmse")).withColumn("height", F.greatest("height", F.lit(0.0)))
    tall = tall.withColumn("canopy", (F.col("kind") == "grass") & (F.col("height") > o.tallest))
    at = grid.stations(tall.select("road", "frame", "kind", "r", "c", "height", "canopy", "length", _along("a").alias("x"), _along("b").alias("y")), flat, "road", o.widest)
    inside = F.col("side") == o.side if o.side else F.lit(True)
    if o.drop_past_ends:
        inside = inside & ~F.col("past_end")
    index = lambda value, whole: F.least(F.greatest(F.ceil(whole / o.cell) - 1, F.lit(0)), F.greatest(F.lit(0), F.floor(F.col(value) / o.cell)))
    cell = F.struct("road", index("along", F.col("length")).alias("column"), index("distance", F.lit(o.widest)).alias("row"))
    voxel = F.struct(*(F.floor(F.col(c) / o.voxel).alias(c) for c in ("along", "distance", "height")))
    return at.where(inside).select(cell.alias("cell"), "frame", "kind", voxel.alias("voxel"), "height", "canopy", "r", "c")


def ground_is_small(ground: DataFrame, rows: int = 100_000) -> bool:
    return ground.limit(rows + 1).count() <= rows


def reduced(observations: DataFrame, o: Options) -> DataFrame:
    """A row for each cell that grass was seen in: heights over the plane and over the cell's own ground, votes,
    status, reason, evidence frames. Cells that only structure stands in have none."""
    grass = observations.where("kind = 'grass' AND NOT canopy")
    voxels = cut(cells.voxel_minima(grass))
    votes = cut(cells.frame_votes(voxels, o.least_voxels).withColumn("gap", F.coalesce("gap", F.lit(0.0))))
    touched = voxels.groupBy("cell").agg(F.slice(F.array_sort(F.collect_set("frame")), 1, 3).alias("_seen"))
    middle = lambda c: nearest_rank(c, 0.5)
    told = votes.groupBy("cell").agg(F.count("*").alias("frames"), F.sum("voxels").alias("samples"), *(middle(c).alias(c) for c in ("h50", "h90", "h95", "gap")), (F.max("h95") - F.min("h95")).alias("spread"), middle("ground").alias("_own"), *(middle(f"greatest(0.0D, {c} - ground)").alias(f"_{c}") for c in ("h50", "h90", "h95")))
    known = F.col("frames") >= o.least_frames
    sure = told.where(known)
    ground = cells.pooled_ground(voxels, votes.join(sure.select("cell"), "cell", "left_semi"))
    evidence = shown(votes, sure)
    at = touched.join(told, "cell", "left").join(ground.withColumnsRenamed({"ground": "_pooled"}), "cell", "left").join(evidence, "cell", "left")
    datum = F.col("_own") if o.own_datum else F.col("_pooled")
    extents = {f"extent{c[1:]}": F.when(known, F.col(f"_{c}") if o.own_datum else F.greatest(F.lit(0.0), F.col(c) - F.col("_pooled"))) for c in ("h50", "h90", "h95")}
    at = at.withColumns({"ground": F.when(known, datum), **extents, **{c: F.when(known, F.col(c)) for c in ("h50", "h90", "h95", "gap", "spread", "contacts")}, "frames": F.coalesce("frames", F.lit(0)), "samples": F.coalesce("samples", F.lit(0)), "evidence": F.coalesce("evidence", "_seen")})
    if o.structure_frames < float("inf"):
        stands = observations.where("kind = 'structure'").groupBy("cell", "frame").agg(F.count_distinct("voxel").alias("n")).where(F.col("n") >= o.least_voxels).groupBy("cell").agg(F.count("*").alias("structure_frames"))
        at = at.join(stands, "cell", "left").withColumn("structure_frames", F.coalesce("structure_frames", F.lit(0)))
    else:
        at = at.withColumn("structure_frames", F.lit(0).cast("long"))
    reason = (
        F.when(F.col("frames") < o.least_frames, F.when(F.col("frames") > 0, "too few frames").otherwise("too few samples"))
        .when(F.col("structure_frames") >= o.structure_frames, "a structure stands here")
        .when(F.col("extent95") > o.canopy_extent, "above the canopy's extent")
        .when(F.col("gap") > o.canopy_gap, "floats above the ground")
    )
    status = F.when(F.col("reason").isNull(), "measured").when(F.col("reason").startswith("too few"), "abstained").when(F.col("reason").startswith("a structure"), "structure").otherwise("canopy")
    at = at.withColumn("reason", reason).withColumn("status", status)
    if o.slope_rise < float("inf"):
        at = on_slopes(at, o.slope_rise)
    centre = lambda k: (F.col(f"cell.{k}") + 0.5) * o.cell
    return at.select("cell.*", centre("column").alias("along_m"), centre("row").alias("distance_m"), "ground", "contacts", "extent50", "extent90", "extent95", "h50", "h90", "h95", "frames", "samples", "spread", "gap", "structure_frames", "status", "reason", "evidence")


def on_slopes(at: DataFrame, rise: float) -> DataFrame:
    """Cells from the foot of a slope on: the first of a column's cells with a ground (structures left out) that
    rises from the one before, and the next from it."""
    column = Window.partitionBy("cell.road", "cell.column").orderBy("cell.row")
    firm = at.where("ground IS NOT NULL AND status <> 'structure'").select("cell", "ground")
    up = lambda a, b: a - b > rise
    firm = firm.withColumn("_foot", up(F.col("ground"), F.lag("ground").over(column)) & up(F.lead("ground").over(column), F.col("ground")))
    foot = firm.where("_foot").groupBy(F.col("cell.road").alias("_road"), F.col("cell.column").alias("_column")).agg(F.min("cell.row").alias("_from"))
    both = at.join(foot, (F.col("cell.road") == F.col("_road")) & (F.col("cell.column") == F.col("_column")), "left")
    beyond = F.coalesce(F.col("cell.row") >= F.col("_from"), F.lit(False)) & F.col("status").isin("measured", "canopy")
    return both.withColumns({"status": F.when(beyond, "slope").otherwise(F.col("status")), "reason": F.when(beyond, "beyond the slope's foot").otherwise(F.col("reason"))}).drop("_road", "_column", "_from")


def shown(votes: DataFrame, sure: DataFrame) -> DataFrame:
    """Frames that show a cell's height: best agreement, largest disagreement, weakest support, then the next
    best; each once, three at most."""
    v = votes.join(sure.select("cell", F.col("h95").alias("_h")), "cell").withColumn("off", F.abs(F.col("h95") - F.col("_h")))
    first = lambda *order: F.min(F.struct(*order, "frame"))["frame"]
    near = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("off", "frame"))), 1, 3), lambda x: x["frame"])
    picks = v.groupBy("cell").agg(first("off").alias("a"), first((-F.col("off")).alias("o")).alias("b"), first("voxels").alias("w"), near.alias("n"))
    return picks.select("cell", F.slice(F.array_distinct(F.concat(F.array("a", "b", "w"), "n")), 1, 3).alias("evidence"))


def assess(pixels: DataFrame, cameras: DataFrame, edges: DataFrame, grounds: DataFrame, lens: tuple[float, float, float, float], o: Options = Options()) -> DataFrame:
    """The whole way, from pixels (road, frame, r, c, depth, conf, grass, structure) to cells."""
    return reduced(cut(placed(observed(pixels, o), cameras, edges, grounds, lens, o)), o)


def summary(assessed: DataFrame) -> DataFrame:
    """Of each road: cells by status, coverage, ranges, and cells to look at with the reason for each. A cell is
    listed for its first reason; of equals the first along the road and then away from it counts."""
    measured, x = F.col("status") == "measured", F.col("extent95")
    middle = assessed.where("status = 'measured'").groupBy("road").agg(nearest_rank("extent95", 0.5).alias("_middle"))
    pick = lambda *order, of=measured: F.min(F.when(of, F.struct(*(e.alias(f"o{i}") for i, e in enumerate(order)), "column", "row", "evidence")))
    reasons = {
        "lowest": pick(x),
        "median": pick(F.abs(x - F.col("_middle"))),
        "highest": pick(-x),
        "least supported": pick(F.col("frames"), F.col("samples")),
        "most disputed": pick(-F.coalesce("spread", F.lit(0.0))),
        "abstained": pick(of=F.col("status") == "abstained"),
    }
    told = assessed.join(middle, "road", "left").groupBy("road").agg(
        F.count("*").alias("cells"),
        *(counted(F.col("status") == s).alias(s) for s in ("measured", "abstained", "canopy", "slope", "structure")),
        *(e.alias(n) for c in ("h95", "extent95") for n, e in ((f"{c}_low", F.min(F.when(measured, F.col(c)))), (f"{c}_high", F.max(F.when(measured, F.col(c)))))),
        F.array(*(F.struct(F.lit(r).alias("reason"), p["column"].alias("column"), p["row"].alias("row"), p["evidence"].alias("evidence")) for r, p in reasons.items())).alias("_p"),
    )
    place = lambda p: F.struct(p["column"], p["row"])
    firsts = F.filter("_p", lambda p, i: p["column"].isNotNull() & (F.array_position(F.transform("_p", place), place(p)) == i + 1))
    return told.withColumns({"coverage": share(F.col("measured"), F.col("cells")), "samples": firsts}).drop("_p")
