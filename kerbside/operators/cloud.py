"""Point clouds: voxels, weights, ground planes, levels and components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.stats import nearest_rank
from kerbside.operators import grid
from kerbside.operators.stages import cut
from kerbside.session import ship_package


def voxel_centroids(points: DataFrame, edge: float) -> DataFrame:
    """Weighted centroid and mean weight of each occupied voxel."""
    at = [F.floor(F.col(c) / edge).alias(f"v{c}") for c in "xyz"]
    mean = [F.try_divide(F.sum(F.col(c) * F.col("w")), F.sum("w")).alias(c) for c in "xyz"]
    return points.groupBy(*at).agg(*mean, F.avg("w").alias("w"), F.count("*").alias("n"))


def weights_to_mean_one(points: DataFrame) -> DataFrame:
    """Points with `weight`, which is w over the mean of all w."""
    mean = points.agg(F.avg("w").alias("_m"))
    return points.crossJoin(F.broadcast(mean)).withColumn("weight", F.try_divide("w", F.col("_m"))).drop("_m")  # rows by one row


def build(pixels: DataFrame, cameras: DataFrame, lens: tuple[float, float, float, float], least_confidence: float, most_step: float, weight: str, edge: float) -> DataFrame:
    """A cloud from depth pixels (frame, r, c, depth, conf): usable ones above their frame's floor, in the
    world, as voxel centroids weighted by `weight` (by_none, by_rank or by_confidence), weights of mean 1.

    Ranks are those among all of a frame's pixels. Two aggregations by frame, one by voxel.
    """
    usable = grid.with_reject(pixels, least_confidence, most_step).where("reject IS NULL").drop("reject")
    floor = grid.floors(pixels).select("frame", "middle")
    kept = grid.with_weights(usable.join(floor, "frame").where(F.col("conf") >= F.col("middle")), pixels).withColumn("w", F.col(weight))
    return weights_to_mean_one(voxel_centroids(grid.to_world(kept, cameras, *lens).select("x", "y", "z", "w"), edge))


def confidence_floor(pixels: DataFrame, by: str, value: str) -> DataFrame:
    """Each frame's floor: the 40th percentile of its confidences, not below 1.05 nor above the 90th."""
    floor = F.least(F.greatest(F.lit(1.05), nearest_rank(value, 0.4)), nearest_rank(value, 0.9))
    return pixels.groupBy(by).agg(floor.alias("floor"), F.count("*").alias("pixels"))


def plane_fit(points: DataFrame, by: list[str]) -> DataFrame:
    """Weighted least squares y = a x + b z + c of each group: one aggregation, then Cramer's rule."""
    w, x, y, z = (F.col(c) for c in ("w", "x", "y", "z"))
    sums = {"s": w, "sx": w * x, "sz": w * z, "sy": w * y, "sxx": w * x * x, "szz": w * z * z, "sxz": w * x * z, "sxy": w * x * y, "szy": w * z * y}
    g = points.groupBy(*by).agg(*(F.sum(v).alias(k) for k, v in sums.items()))

    def det(rows: list[list[str]]) -> Column:
        (a, b, c), (d, e, f), (g_, h, i) = [[F.col(v) for v in r] for r in rows]
        return a * (e * i - f * h) - b * (d * i - f * g_) + c * (d * h - e * g_)

    whole = [["sxx", "sxz", "sx"], ["sxz", "szz", "sz"], ["sx", "sz", "s"]]
    right = ["sxy", "szy", "sy"]
    swapped = lambda k: [[right[i] if j == k else whole[i][j] for j in range(3)] for i in range(3)]
    return g.select(*by, *(F.try_divide(det(swapped(k)), det(whole)).alias(n) for k, n in enumerate("abc")))


def height_profile(points: DataFrame, by: list[str], height: str) -> DataFrame:
    """Upper and lower percentiles of heights and the extent between them."""
    return points.groupBy(*by).agg(nearest_rank(height, 0.98).alias("p98"), nearest_rank(height, 0.02).alias("p2"), F.count("*").alias("n")).withColumn("extent", F.col("p98") - F.col("p2"))


def tails(points: DataFrame, by: list[str], height: str, order: str, least: int = 40, part: float = 0.1) -> DataFrame:
    """The lowest and highest tenth of each group, `least` at least but no more than half."""
    whole = Window.partitionBy(*by)
    n = F.count("*").over(whole)
    size = F.least(F.greatest(F.lit(least), F.floor(n * part)), F.floor(n / 2))
    low = F.row_number().over(whole.orderBy(F.col(height).asc(), F.col(order).asc()))
    high = F.row_number().over(whole.orderBy(F.col(height).desc(), F.col(order).desc()))
    t = points.withColumns({"_n": size, "_lo": low, "_hi": high})
    return t.withColumn("tail", F.when(F.col("_lo") <= F.col("_n"), "low").when(F.col("_hi") <= F.col("_n"), "high")).where("tail IS NOT NULL").drop("_n", "_lo", "_hi")


def horizontal_levels(points: DataFrame, by: list[str], height: str, bin_m: float = 0.005, reach: int = 10, prominence: float = 2.0) -> DataFrame:
    """Peaks of each group's histogram: the greatest bin within reach, the lower of equals, that stands
    out from the median of the non-empty bins around it."""
    bins = points.groupBy(*by, F.floor(F.col(height) / bin_m).alias("bin")).agg(F.count("*").alias("n"))
    near = Window.partitionBy(*by).orderBy("bin").rangeBetween(-reach, reach)
    below = Window.partitionBy(*by).orderBy("bin").rangeBetween(-reach, -1)
    around = F.percentile(F.col("n"), F.lit(0.5)).over(near)
    peak = bins.withColumns({"_max": F.max("n").over(near), "_low": F.coalesce(F.max("n").over(below), F.lit(0)), "_mid": around})
    return peak.where((F.col("n") == F.col("_max")) & (F.col("_low") < F.col("n")) & (F.col("n") >= prominence * F.col("_mid"))).select(*by, "bin", (F.col("bin") * bin_m).alias("level"), "n")


def connected_voxels(voxels: DataFrame, by: str) -> DataFrame:
    """Component sizes of occupied voxels (by, vx, vy, vz) with 26 neighbours each.

    Neighbours meet by equal keys. Each voxel takes the least label about it and then its label's own
    label until none changes, so an object may be larger than a task. Repeated voxels count once.
    """
    node = lambda *at: F.struct(F.col(by).alias("g"), *(c.cast("long").alias(n) for n, c in zip("xyz", at, strict=True)))
    places = [F.col(c) for c in ("vx", "vy", "vz")]
    own = voxels.select(by, *(c.cast("long") for c in places)).distinct()
    around = F.explode(F.array(*(node(*(c + F.lit(i) for c, i in zip(places, step, strict=True))) for step in product((-1, 0, 1), repeat=3))))
    edges = cut(own.select(node(*places).alias("u"), around.alias("v")).join(own.select(node(*places).alias("v")), "v"))
    labels = edges.groupBy("u").agg(F.min("v").alias("label"))
    while True:
        near = edges.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("least"))
        step = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        up = labels.select(F.col("u").alias("label"), F.col("label").alias("above"))
        now = cut(step.join(up, "label").select("u", "old", F.least("label", "above").alias("label")))
        if now.where("old != label").isEmpty():
            break
        labels = now.select("u", "label")
    sizes = now.groupBy("label").agg(F.count("*").alias("n")).groupBy(F.col("label.g").alias(by))
    return sizes.agg(F.sum("n").alias("voxels"), F.count("*").alias("components"), (F.max("n") / F.sum("n")).alias("largest_share"))


def eroded(masks: DataFrame, column: str, width: int, radius: int) -> DataFrame:
    """Masks (arrays of 0 and 1, row by row) where the whole square around a pixel is set; outside counts as 0."""
    ship_package(masks.sparkSession)
    columns = masks.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for m in b[column]:
                grid = np.pad(np.asarray(m, np.int8).reshape(-1, width), radius)
                view = np.lib.stride_tricks.sliding_window_view(grid, (2 * radius + 1, 2 * radius + 1))
                out.append(view.min(axis=(2, 3)).ravel().astype(int).tolist())
            yield b.assign(**{column: out})[columns]

    return masks.mapInPandas(run, masks.schema)


def top_roughness(points: DataFrame, by: list[str], height: str, band: float = 0.05) -> DataFrame:
    """The 98th percentile and the scaled median absolute deviation of heights within the band around it."""
    from kerbside.functions.stats import NORMAL

    top = points.groupBy(*by).agg(nearest_rank(height, 0.98).alias("p98"))
    near = points.join(top, by).where(F.abs(F.col(height) - F.col("p98")) <= band)
    middle = near.groupBy(*by).agg(nearest_rank(height, 0.5).alias("_m"), F.count("*").alias("n"))
    off = near.join(middle, by).withColumn("_d", F.abs(F.col(height) - F.col("_m"))).groupBy(*by).agg((nearest_rank("_d", 0.5) * NORMAL).alias("roughness"))
    return top.join(middle.drop("_m"), by).join(off, by)


def uniform_cap(points: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """`most` rows by the least hashes of their keys: the same rows whatever the partitions."""
    return points.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(most)


def strided(points: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """Every k-th row of each group, k the least that leaves at most `most`."""
    whole = Window.partitionBy(*by)
    k = F.greatest(F.lit(1), F.ceil(F.count("*").over(whole) / most))
    return points.withColumns({"_k": k, "_i": F.row_number().over(whole.orderBy(order)) - 1}).where("_i % _k = 0").drop("_k", "_i")


def points_of_tracks(points: DataFrame, tracks: int) -> DataFrame:
    """Points as poses of tracks: track, k (their order in it) and place."""
    return points.select((F.col("point_id") % tracks).alias("track"), F.col("point_id").alias("k"), "x", "y", "z")
