"""Erosion against numpy; long roads keep their cells apart; statuses of a made road."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import grid, roadside
from kerbside.plans import roadside as plans

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_erosion_equals_windows(spark, radius):
    d = np.random.default_rng(radius)
    masks = {f: d.random((12, 17)) < 0.96 for f in range(3)}
    rows = [("a", f, r, c, bool(m[r, c])) for f, m in masks.items() for r in range(12) for c in range(17) if (f, r, c) != (2, 5, 5)]  # one pixel is missing
    masks[2][5, 5] = False
    out = roadside.eroded(spark.createDataFrame(rows, "road string, frame int, r int, c int, grass boolean"), "grass", radius, roadside.FRAME, "kept")
    want = set()
    for f, m in masks.items():
        view = np.lib.stride_tricks.sliding_window_view(np.pad(m, radius), (2 * radius + 1, 2 * radius + 1)).all(axis=(2, 3))
        want |= {(f, int(r), int(c)) for r, c in zip(*np.nonzero(view), strict=True)}
    assert {(x.frame, x.r, x.c) for x in out.where("kept").collect()} == want and want


def test_tasks_of_frames_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(roadside, "TASK_PIXELS", 500)
    px = scene(spark, lambda x, y: 0.2, frames=60)[0]
    got = roadside.eroded(px, "grass", 1, roadside.FRAME, "kept", "step")
    sizes = [r.n for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 60 * 81 and len(sizes) >= 6 and max(sizes) <= 2000
    step = px.withColumn("want", grid.neighbour_step(roadside.FRAME))
    assert got.join(step, [*roadside.FRAME, "r", "c"]).where("step <=> want").count() == 60 * 81
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2  # one for each direction


def test_two_long_roads_keep_their_cells_apart(spark):
    got = plans.assessed(spark, SF).select("road", "column", "row", "along_m", "frames").collect()
    for road in (0, 1):
        columns = {r.column for r in got if r.road == road}
        assert len(columns) > 900 and max(columns) > 1000
    assert len({(r.road, r.column, r.row) for r in got}) == len(got)
    assert all(r.frames <= 6 for r in got)  # frames of 12 m, 3 m apart: no cell has votes from elsewhere


def scene(spark, tall, frames=4, structure=False, conf=None):
    """Frames of 9 by 9 pixels, 1 m each, from 20 m above a straight road along x; tall(x, y) is what stands there."""
    rows = [("r", f, r, c, 20.0 - tall(c - 4, r), conf, True, structure) for f in range(frames) for r in range(9) for c in range(9)]
    px = spark.createDataFrame(rows, "road string, frame int, r int, c int, depth double, conf double, grass boolean, structure boolean")
    turn = {f"r{i}{j}": float((i == j) * (-1 if i == 2 else 1)) for i in range(3) for j in range(3)}
    cams = spark.createDataFrame([("r", f, *turn.values(), 0.0, 0.0, 20.0) for f in range(frames)], "road string, frame int, " + ", ".join(f"{k} double" for k in turn) + ", t0 double, t1 double, t2 double")
    edge = spark.createDataFrame([("r", 0, -10.0, 0.0, 0.0), ("r", 1, 10.0, 0.0, 0.0)], "road string, ord int, x double, y double, z double")
    ground = spark.createDataFrame([("r", 0.0, 0.0, 1.0, 0.0, 0.01, 0.0, 0.0, 1.0)], "road string, nx double, ny double, nz double, offset double, rmse double, ux double, uy double, uz double")
    return px, cams, edge, ground


BASE = roadside.Options(widest=8.0, cell=4.0, voxel=0.5, least_frames=3, least_voxels=3, erosion=0, most_step=0.5, side=1)
LENS = (20.0, 20.0, 4.0, 0.0)


def assess(spark, tall, o=BASE, **more):
    return {(r.column, r.row): r for r in roadside.assess(*scene(spark, tall, **more), LENS, o).collect()}


def test_statuses(spark):
    flat = assess(spark, lambda x, y: 0.2)
    assert {r.status for r in flat.values()} == {"measured"} and {r.frames for r in flat.values()} == {4}
    assert all(r.h95 == pytest.approx(0.2) and r.extent95 == pytest.approx(0.0) and len(r.evidence) == 3 for r in flat.values())
    few = assess(spark, lambda x, y: 0.2, frames=2)
    assert {(r.status, r.reason, r.ground) for r in few.values()} == {("abstained", "too few frames", None)}
    thin = assess(spark, lambda x, y: 0.2, BASE._replace(least_voxels=1000))
    assert {r.reason for r in thin.values()} == {"too few samples"}
    tree = assess(spark, lambda x, y: 3.0 if (x + y) % 2 else 0.1, BASE._replace(canopy_extent=1.0))
    assert {r.reason for r in tree.values()} == {"above the canopy's extent"}
    gap = assess(spark, lambda x, y: 0.9 if (x + y) % 2 else 0.1, BASE._replace(canopy_gap=0.5, canopy_extent=1.0))
    assert {r.reason for r in gap.values()} == {"floats above the ground"}
    cut_off = assess(spark, lambda x, y: 3.0 if (x + y) % 2 else 0.1, BASE._replace(tallest=2.0))
    assert {r.status for r in cut_off.values()} == {"measured"} and max(r.h95 for r in cut_off.values()) < 0.2
    wall = assess(spark, lambda x, y: 0.2, BASE._replace(structure_frames=2.0), structure=True)
    assert {(r.status, r.structure_frames) for r in wall.values()} == {("structure", 4)}


def test_a_slope_begins_at_its_foot(spark):
    o = BASE._replace(cell=2.0, slope_rise=0.2)
    got = assess(spark, lambda x, y: max(0.0, (y - 2) * 0.2), o)
    column = sorted(r.row for r in got.values() if r.status == "slope" and r.column == 5)
    rows = sorted(r.row for r in got.values() if r.column == 5)
    assert column and column == rows[rows.index(column[0]) :] and column[0] > 0
    summary = roadside.summary(roadside.assess(*scene(spark, lambda x, y: max(0.0, (y - 2) * 0.2)), LENS, o)).first()
    assert summary.cells == len(got) and summary.slope == sum(r.status == "slope" for r in got.values()) and summary.samples[0].reason == "lowest"


def test_odd_roads(spark):
    px, cams, edge, ground = scene(spark, lambda x, y: 0.2)
    assert roadside.assess(px.where("false"), cams, edge, ground, LENS, BASE).count() == 0
    assert roadside.assess(px, cams, edge.where("ord = 0"), ground, LENS, BASE).count() == 0
    edge_on = ground.withColumns({"nx": F.lit(1.0), "nz": F.lit(0.0)})
    assert roadside.assess(px, cams, edge, edge_on, LENS, BASE).count() == 0
    none = px.withColumn("depth", F.lit(None).cast("double"))
    assert roadside.assess(none, cams, edge, ground, LENS, BASE).count() == 0


def test_stations_within_reach_are_those_of_all_pieces(spark):
    from kerbside.operators import grid

    d = np.random.default_rng(4)
    line = [(r, k, float(7 * k + d.normal(0, 2)), float(d.normal(0, 6))) for r in ("a", "b") for k in range(30)]
    lines = spark.createDataFrame(line, "road string, ord long, x double, y double")
    points = spark.createDataFrame([(k, "ab"[k % 2], float(d.uniform(-20, 230)), float(d.normal(0, 12))) for k in range(600)], "k long, road string, x double, y double")
    for reach in (0.5, 3.0, 40.0):
        want = grid.stations(points, lines, "road").where(F.col("distance") <= reach)
        got = grid.stations(points, lines, "road", reach)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
