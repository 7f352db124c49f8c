"""Heights of grid cells from votes of frames, and statistics of measured things."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.stats import NORMAL, counted, nearest_rank, share

#: Voxels that make a frame's vote, votes that make a cell's height.
LEAST_VOXELS, LEAST_VOTES = 20, 3


def voxel_minima(samples: DataFrame) -> DataFrame:
    """The lowest height of each voxel that a frame sees in a cell."""
    return samples.groupBy("cell", "frame", "voxel").agg(F.min("height").alias("height"))


def frame_votes(voxels: DataFrame, least: int = LEAST_VOXELS) -> DataFrame:
    """Nearest-rank percentiles of each frame with enough voxels in a cell, and its widest gap that has a
    tenth of the voxels above it."""
    order = Window.partitionBy("cell", "frame").orderBy("height", "voxel")
    whole = Window.partitionBy("cell", "frame")
    ranked = voxels.withColumns({"r": F.row_number().over(order), "n": F.count("*").over(whole), "gap": F.lead("height").over(order) - F.col("height")})
    counts = F.col("r") <= F.col("n") - F.ceil(F.col("n") * 0.1)
    votes = ranked.groupBy("cell", "frame").agg(F.count("*").alias("voxels"), nearest_rank("height", 0.5).alias("h50"), nearest_rank("height", 0.9).alias("h90"), nearest_rank("height", 0.95).alias("h95"), nearest_rank("height", 0.02).alias("ground"), F.max(F.when(counts, F.col("gap"))).alias("gap"))
    return votes.where(F.col("voxels") >= least)


def cell_heights(votes: DataFrame, least: int = LEAST_VOTES) -> DataFrame:
    """One frame, one vote: the lower median of the frames' percentiles, or a reason for none."""
    known = F.col("votes") >= least
    g = votes.groupBy("cell").agg(F.count("*").alias("votes"), *(nearest_rank(c, 0.5).alias(c) for c in ("h50", "h90", "h95")), (F.max("h95") - F.min("h95")).alias("spread"), F.sum("voxels").alias("samples"))
    return g.select("cell", "votes", *(F.when(known, F.col(c)).alias(c) for c in ("h50", "h90", "h95", "spread")), "samples", F.when(~known, "too few votes").alias("reason"))


def pooled_ground(voxels: DataFrame, votes: DataFrame, contact: float = 0.05) -> DataFrame:
    """Ground of each cell over the voxels of all voting frames, and how many voxels touch it."""
    pooled = voxels.join(votes.select("cell", "frame"), ["cell", "frame"], "left_semi").groupBy("cell", "voxel").agg(F.min("height").alias("height"))
    ground = pooled.groupBy("cell").agg(nearest_rank("height", 0.02).alias("ground"))
    return pooled.join(ground, "cell").groupBy("cell", "ground").agg(counted(F.col("height") <= F.col("ground") + contact).alias("contacts"))


def own_ground(votes: DataFrame) -> DataFrame:
    """Heights above each frame's own ground, never below 0."""
    return votes.groupBy("cell").agg(*(F.percentile_approx(F.greatest(F.col(c) - F.col("ground"), F.lit(0.0)), 0.5, 1000000).alias(f"{c}_above") for c in ("h50", "h95")))


def slope_foot(cells: DataFrame, rise: float) -> DataFrame:
    """Cells (column, row, ground) from the first of two successive rises on are marked."""
    o = Window.partitionBy("column").orderBy("row")
    up, next_up = F.col("ground") - F.lag("ground").over(o) > rise, F.lead("ground").over(o) - F.col("ground") > rise
    foot = F.min(F.when(F.col("_foot"), F.col("row"))).over(Window.partitionBy("column"))
    return cells.withColumn("_foot", F.coalesce(up & next_up, F.lit(False))).withColumn("on_slope", F.coalesce(F.col("row") >= foot, F.lit(False))).drop("_foot")


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two assessments side by side; what one lacks is not observed."""
    x, y = a.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_a")), b.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_b"))
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "not observed").otherwise("both")
    return x.join(y, keys, "full_outer").select(*keys, "before", "after", (F.col("after") - F.col("before")).alias("delta"), status.alias("status"))


def mask_scores(pixels: DataFrame, truth: str, guess: str, by: list[str]) -> DataFrame:
    """Intersection over union, recall and precision; null where nothing could be right."""
    t, g = F.col(truth), F.col(guess)
    c = pixels.groupBy(*by).agg(counted(t & g).alias("tp"), counted(~t & g).alias("fp"), counted(t & ~g).alias("fn"))
    tp, fp, fn = (F.col(x) for x in ("tp", "fp", "fn"))
    return c.select(*by, "tp", "fp", "fn", share(tp, tp + fp + fn).alias("iou"), share(tp, tp + fn).alias("recall"), share(tp, tp + fp).alias("precision"))


def error_model(observations: DataFrame) -> DataFrame:
    """How predictions relate to truths: a factor through the origin, a line, and the errors."""
    t, p = F.col("truth"), F.col("predicted")
    return observations.agg(F.count("*").alias("n"), F.try_divide(F.sum(t * p), F.sum(p * p)).alias("factor"), F.regr_slope("truth", "predicted").alias("slope"), F.regr_intercept("truth", "predicted").alias("intercept"), F.sqrt(F.avg((p - t) * (p - t))).alias("rms"), F.max(F.abs(p - t)).alias("max_abs"), F.avg(F.abs(p - t) / F.abs(t)).alias("abs_rel"))


def trial_statistics(trials: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, lower median and the median absolute deviation scaled to a normal's (from three trials on)."""
    middle = trials.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), nearest_rank(value, 0.5).alias("median"), (F.max(value) - F.min(value)).alias("range"))
    off = trials.join(middle.select(by, "median"), by).withColumn("_d", F.abs(F.col(value) - F.col("median"))).groupBy(by).agg((nearest_rank("_d", 0.5) * NORMAL).alias("nmad"))
    return middle.join(off, by).withColumn("nmad", F.when(F.col("n") >= 3, F.col("nmad")))


def cell_status(cells: DataFrame, structure_votes: int = 3, canopy_extent: float = 2.0, canopy_gap: float = 0.5) -> DataFrame:
    """structure before canopy (by extent, then by gap) before measured; without a height it abstained."""
    status = F.when(F.col("structure") >= structure_votes, "structure").when(F.col("h95").isNull(), "abstained").when(F.col("h95") > canopy_extent, "canopy").when(F.col("gap") > canopy_gap, "canopy").otherwise("measured")
    return cells.withColumn("status", status)


def quality_summary(cells: DataFrame, by: list[str]) -> DataFrame:
    """Tallies of statuses, coverage, the greatest spread, and what blocks acceptance."""
    g = cells.groupBy(*by).agg(F.count("*").alias("cells"), counted(F.col("status") == "measured").alias("measured"), counted(F.col("status") == "abstained").alias("abstained"), F.max("spread").alias("spread"), counted(F.col("h95") > 0.1).alias("above_middle"), counted(F.col("h95") > 0.3).alias("above_tall"))
    blockers = F.array_compact(F.array(F.when(F.col("measured") == 0, "nothing measured"), F.when(F.col("abstained") > F.col("measured"), "mostly abstained"), F.when(F.col("spread") > 0.2, "frames disagree")))
    return g.withColumns({"coverage": share(F.col("measured"), F.col("cells")), "blockers": F.array_join(blockers, "; ")})


def review_picks(cells: DataFrame, by: list[str], key: str) -> DataFrame:
    """Cells to look at: the tallest, the lowest, the one whose frames differ most and the least supported."""
    measured = cells.where(F.col("h95").isNotNull())
    pick = lambda f, c, sign: f(key, F.struct(F.col(c), sign * F.col(key)))
    return measured.groupBy(*by).agg(pick(F.max_by, "h95", -1).alias("tallest"), pick(F.min_by, "h95", 1).alias("lowest"), pick(F.max_by, "spread", -1).alias("widest"), pick(F.min_by, "samples", 1).alias("weakest"))


def class_fractions(scores: DataFrame, by: list[str], array: str) -> DataFrame:
    """Share of each class, the class of a row being its highest score and of equals the lowest class."""
    best = (F.array_position(array, F.array_max(array)) - 1).cast("long")
    n = scores.select(*by, best.alias("class")).groupBy(*by, "class").agg(F.count("*").alias("n"))
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
