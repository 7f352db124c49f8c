"""Edges of made tracks, and the way back from the world to the road's frame."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerbside.operators import grid, roadframe

POSES = "road string, ord long, x double, y double, z double"


def ground(spark, *roads, normal=(0.0, 2.0, 0.0), offset=0.0):
    return spark.createDataFrame([(r, *normal, offset) for r in roads], "road string, nx double, ny double, nz double, offset double")


def test_an_edge_lies_beside_its_track(spark):
    rows = [("a", k, 0.2 * k, 1.5, 0.0) for k in range(40)] + [("b", 0, 0.0, 0.0, 0.0), ("b", 1, 0.1, 0.0, 0.0)] + [("c", 0, 1.0, 1.0, 1.0), ("c", 1, 1.0, 5.0, 1.0)] + [("a", 99, float("nan"), 0.0, 0.0), ("a", 98, None, 0.0, 0.0), ("d", 0, float("inf"), 0.0, 0.0)]
    found = {}
    for r in roadframe.edges(spark.createDataFrame(rows, POSES), ground(spark, "a", "b", "c", "d"), 2.0).orderBy("road", "ord").collect():
        found.setdefault(r.road, []).append((r.x, r.y, r.z))
    # Left of the way along x, seen from above (y up), is -z; poses 0.2 m apart leave every third.
    assert found["a"] == [pytest.approx((0.6 * k, 0.0, -2.0)) for k in range(14)]
    assert found["b"] == [pytest.approx((0.0, 0.0, -2.0)), pytest.approx((0.1, 0.0, -2.0))]  # its far end is kept
    assert set(found) == {"a", "b"}  # c moved upwards only
    told = {r.road: r.source_poses for r in roadframe.thinned_tracks(spark.createDataFrame(rows, POSES), ground(spark, "a")).collect()}
    assert told == {"a": 42}


@pytest.mark.parametrize("side", [-1, 1])
def test_the_round_trip_gives_stations_back(spark, side):
    line = [("r", k, 10 * math.cos(k / 9), 0.0, 10 * math.sin(k / 9)) for k in range(28)]
    lines = spark.createDataFrame(line, POSES)
    places = spark.createDataFrame([(k, "r", 0.31 * k + 0.05, 0.02 * (k % 30) + 0.01) for k in range(90)], "k long, road string, along double, distance double")
    world = roadframe.to_world(places, lines, ground(spark, "r"), side=side).withColumnRenamed("along", "was").withColumnRenamed("distance", "far")
    # In the plane's axes (z, x), so that up is y.
    flat = lines.select("road", "ord", F.col("z").alias("x"), F.col("x").alias("y"))
    back = grid.stations(world.select("k", "road", "was", "far", F.col("z").alias("x"), F.col("x").alias("y")), flat, "road")
    rows = back.collect()
    size = 2 * 10 * math.sin(1 / 18)
    for r in rows:
        inner = abs(r.was / size - round(r.was / size)) * size  # near a corner the outer wedge belongs to the vertex
        if inner > 0.1:
            assert r.along == pytest.approx(r.was, abs=1e-6) and r.distance == pytest.approx(r.far, abs=1e-6) and r.side == side
    assert len(rows) == 90


def test_ends_clamp_and_odd_roads_are_null(spark):
    lines = spark.createDataFrame([("r", 0, 0.0, 0.0, 0.0), ("r", 1, 0.0, 0.0, 0.0), ("r", 2, 4.0, 0.0, 0.0), ("one", 0, 1.0, 1.0, 1.0)], POSES)
    places = spark.createDataFrame([(1, "r", -5.0, 1.0), (2, "r", 99.0, 1.0), (3, "one", 1.0, 1.0), (4, "none", 1.0, 1.0), (5, "r", 1.0, 0.0)], "k long, road string, along double, distance double")
    got = {r.k: (r.x, r.y, r.z) for r in roadframe.to_world(places, lines, ground(spark, "r", "one")).collect()}
    assert got[1] == (0.0, 0.0, 1.0) and got[2] == (4.0, 0.0, 1.0) and got[5] == (1.0, 0.0, 0.0)
    assert got[3] == got[4] == (None, None, None)


def test_quads_and_bands(spark):
    lines = spark.createDataFrame([("r", k, float(k), 0.0, 0.0) for k in range(5)], POSES)
    cells = spark.createDataFrame([("r", 1.0, 1.0)], "road string, along_m double, distance_m double")
    quad = [(r.x, r.z) for r in roadframe.cell_quads(cells, lines, ground(spark, "r"), 1.0).orderBy("corner").collect()]
    assert quad == [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]
    band = roadframe.band_segments(lines, ground(spark, "r"), 3.0, 1.5).collect()
    assert sorted((r.kind, r.ord) for r in band) == [("far", k) for k in range(4)] + [("near", k) for k in range(4)] + [("rung", k) for k in (0, 2, 3)]
    assert all((r.bz - r.az, r.ax) == (3.0, r.bx) for r in band if r.kind == "rung")
    assert roadframe.band_segments(lines, ground(spark, "r"), 0.0).count() == 0


def test_tracks_are_thinned_as_a_stream(spark):
    """Over borders of batches, without a track's vertices in one row."""
    xs = [("a", 0.3 * k) for k in range(7)] + [("b", 0.0), ("b", 0.2)] + [("c", 1.0)]
    batches = [pa.RecordBatch.from_pydict({"road": [r], "x": [x], "y": [0.0], "z": [0.0]}) for r, x in xs]
    got = [(r["road"], r["ord"], r["x"]) for b in roadframe.kept_places(iter(batches)) for r in b.to_pylist()]
    assert got == [("a", 0, 0.0), ("a", 1, 0.6), ("a", 2, 1.2), ("a", 3, pytest.approx(1.8)), ("b", 0, 0.0), ("b", 1, 0.2), ("c", 0, 1.0)]


def test_places_meet_the_piece_they_are_on(spark):
    """Short pieces beside one that spans many cells, and places on every vertex."""
    xs = [0.0, 0.001, 0.002, 0.5, 40.0, 40.25, *(40.25 + 0.01 * k for k in range(1, 60))]
    lines = spark.createDataFrame([("r", k, x, 0.0, 0.0) for k, x in enumerate(xs)], POSES)
    where = [*xs, *(0.37 * k - 1 for k in range(120))]
    places = spark.createDataFrame([(k, "r", x, 0.0) for k, x in enumerate(where)], "k long, road string, along double, distance double")
    got = {r.k: r.x for r in roadframe.to_world(places, lines, ground(spark, "r")).collect()}
    assert [got[k] for k in range(len(where))] == pytest.approx([min(max(x, 0.0), xs[-1]) for x in where])
    assert "_line" not in roadframe.pieces(lines).columns  # pieces stay rows


def test_a_track_stays_whole_if_its_ground_is_broadcast_late(spark):
    """The join is planned by shuffles and becomes a broadcast one when the grounds turn out to be few."""
    late = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "4KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    poses = spark.range(0, 400, 1, 8).select((F.col("id") % 2).alias("road"), F.col("id").alias("ord"), (F.floor(F.col("id") / 2) * 0.2).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    grounds = ground(spark, "0", "1").withColumn("road", F.col("road").cast("long"))
    for k, v in late.items():
        spark.conf.set(k, v)
    try:
        got = sorted((r.road, r.ord, r.x) for r in roadframe.thinned_vertices(poses, grounds).collect())
    finally:
        for k in late:
            spark.conf.unset(k)
    assert got == [(r, k, pytest.approx(0.6 * k)) for r in (0, 1) for k in range(67)]
