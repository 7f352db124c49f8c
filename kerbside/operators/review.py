"""Judging measurements: uncertainty, scale, decisions, and what a map shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.stats import counted

#: Share of measured to expected length that a scale anchor may have, and outcomes of attempts.
SCALE_RANGE = (0.5, 2.0)
OUTCOMES = ("accepted", "rejected", "failed", "pending")


def outcome_counts(attempts: DataFrame, by: str) -> DataFrame:
    return attempts.groupBy(by).agg(*(counted(F.col("outcome") == o).alias(o) for o in OUTCOMES), F.count("*").alias("total"))


def quadrature(*terms: str) -> dict[str, Column]:
    """The root of the sum of squares of the terms that are positive and finite, and the largest one's name."""
    sound = {t: F.when((F.col(t) > 0) & ~F.isnan(t) & (F.col(t) < float("inf")), F.col(t)) for t in terms}
    total = sum((F.coalesce(v * v, F.lit(0.0)) for v in sound.values()), F.lit(0.0))
    top = F.array_max(F.array(*(F.when(v.isNotNull(), F.struct(v.alias("v"), F.lit(-k).alias("k"))) for k, v in enumerate(sound.values()))))
    return {"uncertainty": F.sqrt(total), "dominant": F.element_at(F.array(*map(F.lit, terms)), 1 - top["k"])}


def scale_anchor(expected: str, measured: str, least: float) -> dict[str, Column]:
    """The scale of an anchor, or why it cannot be one."""
    scale = F.try_divide(F.col(expected), F.col(measured))
    reason = F.when(F.col(expected).isNull() | F.col(measured).isNull(), "unknown").when((F.col(expected) < least) | (F.col(measured) < least), "short").when(~scale.between(*SCALE_RANGE), "scale")
    return {"reason": reason, "scale": F.when(reason.isNull(), scale)}


def decision_fault() -> Column:
    """Why a review's decision does not count: accepting needs all checks, rejecting needs a note."""
    checks = F.col("ground_ok") & F.col("top_ok") & F.col("frames_ok")
    accept = F.when(~F.coalesce(checks, F.lit(False)), "checks")
    reject = F.when(F.coalesce(F.length(F.trim("note")), F.lit(0)) == 0, "note")
    return F.when(F.col("decision") == "accept", accept).when(F.col("decision") == "reject", reject).otherwise("decision")


def verdict(predicted: str, truth: str, uncertainty: str) -> Column:
    near = F.abs(F.col(predicted) - F.col(truth)) <= F.col(uncertainty)
    return F.when(near.isNull(), "unknown").when(near, "agrees").otherwise("differs")


def map_entries(readings: DataFrame, by: str, most: int = 5) -> DataFrame:
    """Of each session the worst level, its readings, and the tallest of them first."""
    window = F.coalesce("window_index", F.lit(-1))
    k = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("height"), "segment_id", window))  # tasks keep no more than `most` of a session
    name = F.concat_ws("/", F.col("segment_id").cast("string"), window.cast("string"))
    top = readings.where("height IS NOT NULL").withColumn("_k", k).where(F.col("_k") <= most).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", name.alias("n")))), lambda r: r["n"]).alias("tallest"))
    g = readings.groupBy(by).agg(F.max(F.coalesce("level", F.lit(0))).alias("worst"), F.count("*").alias("readings"))
    return g.join(top, by, "left").withColumn("tallest", F.coalesce("tallest", F.array().cast("array<string>")))


def level_shares(df: DataFrame, by: str) -> DataFrame:
    """The share of each level among a road's items, in percent."""
    level = F.coalesce("level", F.lit(0))
    return df.groupBy(by).agg(F.count("*").alias("items"), *(F.round(100 * counted(level == k) / F.count("*"), 6).alias(f"level_{k}") for k in range(4)))


def gravity(poses: DataFrame, by: str) -> DataFrame:
    """The mean of the poses' normalised down rows (dx, dy, dz), and their coherence: 1 where all agree."""
    size = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    unit = poses.where(size > 0).select(by, *((F.col(c) / size).alias(c) for c in ("dx", "dy", "dz")))
    g = unit.groupBy(by).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("dx", "dy", "dz")))
    length = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    return g.select(by, "n", *(F.when(length > 0, F.col(f"d{a}") / length).alias(f"g{a}") for a in "xyz"), (length / F.col("n")).alias("coherence"))


def span(poses: DataFrame, by: str) -> DataFrame:
    return poses.groupBy(by).agg(*((F.max(a) - F.min(a)).alias(f"span_{a}") for a in ("x", "y", "z")))
