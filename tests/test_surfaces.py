"""Levels, heights and masks of made scenes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import documents, surfaces, telemetry

POINTS = "g string, x double, y double, z double"


def planes(spark, *names, rmse=None):
    return spark.createDataFrame([(n, 0.0, 1.0, 0.0, 0.0, rmse) for n in names], "g string, nx double, ny double, nz double, offset double, rmse double")


def slab(g, height, n, wide=1.0, deep=1.0, noise=0.002, seed=0):
    d = np.random.default_rng(seed)
    return [(g, float(x), float(y), float(z)) for x, y, z in zip(d.uniform(0, wide, n), height + d.normal(0, noise, n), d.uniform(0, deep, n), strict=True)]


def test_levels_are_surfaces_and_no_edges(spark):
    d = np.random.default_rng(9)
    rows = slab("room", 0.0, 4000) + slab("room", 0.75, 2500, seed=1) + slab("room", 1.5, 2500, deep=0.01, seed=2)  # the last is a shelf's lip
    rows += [("room", float(x), float(y), float(z)) for x, y, z in d.uniform((0, -0.2, 0), (1, 2.5, 1), (3000, 3))] + [("room", math.nan, 0.0, 0.0), ("lone", 0.0, 0.0, 0.0), ("none", 0.0, 0.0, 0.0)]
    got = surfaces.levels(spark.createDataFrame(rows, POINTS), planes(spark, "room", "lone"), "g", surfaces.Peaks(least_share=0.05)).orderBy("g", "rank").collect()
    assert [(r.g, r.rank, round(r.height, 2)) for r in got] == [("room", 1, 0.0), ("room", 2, 0.75)]
    assert all(r.thickness < 0.01 and r.extent > 0.2 and r.prominence >= 2 for r in got) and got[0].points > got[1].points > 2400


def test_heights_know_how_sure_they_are(spark):
    rows = slab("box", 0.0, 2000) + slab("box", 1.2, 400, seed=3) + slab("few", 1.0, 100)
    told = {r.g: r for r in surfaces.object_heights(spark.createDataFrame(rows, POINTS), planes(spark, "box", "few", "gone", rmse=0.03), "g").collect()}
    box = told["box"]
    assert box.height == pytest.approx(1.2, abs=0.01) and box.roughness < 0.004 and box.uncertainty == pytest.approx(math.hypot(box.roughness, 0.03)) and box.points == 2400 and box.top_points == 400 and box.failure is None
    assert told["few"].failure == told["gone"].failure == "too few points" and told["few"].height is None and told["gone"].points == 0


def test_shares_by_kind_of_model(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0]), (3, [800.0, 0.0, 799.0]), (4, [])], "k int, s array<double>")
    got = {r.k: r for r in df.select("k", *(surfaces.structure_share(kind, F.col("s"), [0, 2]).alias(kind) for kind in ("classes", "queries", "prompts"))).collect()}
    e = np.exp([1.0, 2.0, 3.0])
    assert got[1].classes == pytest.approx((e[0] + e[2]) / e.sum()) and got[1].queries == pytest.approx(4 / 6) and got[1].prompts == 3.0
    assert got[2].classes == pytest.approx(2 / 3) and got[2].queries == 0.0 and got[3].classes == pytest.approx(1.0) and got[4].queries == 0.0
    with pytest.raises(ValueError, match="kind"):
        surfaces.structure_share("other", F.col("s"), [])


def test_masks_take_the_first_best_class_above_the_probability(spark):
    df = spark.createDataFrame([(1, [5.0, 5.0, 0.0]), (1, [0.0, 9.0, 0.0]), (1, [0.0, 0.4, 0.3]), (1, [0.0, 0.0, 9.0]), (1, [])], "frame int, s array<double>")
    masked = surfaces.grass_mask(df, "s", ["road", "grass", "sky"])
    assert [(r["class"], r.wins, r.grass) for r in masked.collect()] == [(0, False, False), (1, True, True), (1, True, False), (2, False, False), (None, False, False)]
    assert tuple(surfaces.mask_counts(masked, ["frame"]).first()) == (1, 5, 2, 1, 1)


def test_fixes_and_tracks(spark):
    fixes = spark.createDataFrame([("s", 1, 10, 5.0), ("s", 2, 10, 5.0), ("s", 3, 9, 30.0), ("s", 4, 11, 20.0)], "session_id string, event_id int, t long, accuracy double").withColumns({"lat": F.lit(1.0), "lon": F.col("event_id").cast("double")})
    assert [r.event_id for r in telemetry.strictly_newer(fixes).orderBy("event_id").collect()] == [1, 4]
    assert documents.track(fixes, "session_id", "t").first().quality == "unavailable"
    assert documents.track(fixes.where("event_id != 3"), "session_id", "t").first().quality == "degraded"
    assert "quality" not in documents.track(fixes.drop("accuracy"), "session_id", "t").columns
