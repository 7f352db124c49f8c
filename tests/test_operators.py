"""Small fixtures with the edge cases that the operators define."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.functions import geo, levels, stats, text
from kerbside.operators import asof, changes, cloud, documents, places, planes, readings, telemetry
from kerbside.sources import geojson, npz
from kerbside.streaming import messages

READING = "session_id string, segment_id int, window_index int, captured_at timestamp, height double, cells int, level int, quality string, place string, measured_at timestamp, start_m double, end_m double"


def reading(s, i, level, height, place=None):
    return (s, i, None, None, height, 30, level, None, place, None, None, None)


@pytest.fixture(scope="module")
def six(spark):
    return spark.createDataFrame([reading("S", 0, 3, 0.9), reading("S", 1, 2, 0.4, "Rua Paraíso"), reading("T", 0, 2, 0.4), reading("T", 1, 1, 0.05), reading("T", 2, None, None)], READING)


def test_unknown_heights_come_last_both_ways(six):
    down = [r.height for r in readings.page(six, "HEIGHT_DESC").collect()]
    up = [r.height for r in readings.page(six, "HEIGHT_ASC").collect()]
    assert down == [0.9, 0.4, 0.4, 0.05, None] and up == [0.05, 0.4, 0.4, 0.9, None]


def test_pages_do_not_overlap(six):
    pages = [readings.page(six, "no such order", 2, k).collect() for k in (0, 2, 4)]
    keys = [(r.session_id, r.segment_id) for p in pages for r in p]
    assert len(set(keys)) == 5 and keys[1:3] == [("S", 1), ("T", 0)]


def test_search_folds_accents_and_takes_the_term_literally(six):
    assert six.where(text.contains_folded("PARAISO", F.col("place"))).count() == 1
    assert six.where(text.contains_folded("%", F.col("place"))).count() == 0


def test_summary_of_nothing_counts_zero_and_knows_no_height(six):
    row = readings.summary(six.where("false")).first()
    assert row.total == 0 and row.level_3 == 0 and row.tallest is None and row.measured_metres is None


def test_level_zero_is_everything_unknown(six):
    assert six.where(levels.has_level(F.col("level"), 0)).count() == 1
    assert six.where(levels.has_level(F.col("level"), 2)).count() == 2


def test_rollup_keeps_the_worst_window_together(spark):
    w = spark.createDataFrame([(1, 0, 3, 0.4, 5, "2024-01-01"), (1, 1, 3, 0.9, 6, "2024-01-03"), (1, 2, None, None, 7, "2024-01-02")], "segment_id int, window_index int, level int, height double, cells int, measured_at string")
    r = readings.window_rollup(w).first()
    assert (r.level, r.height, r.window_index, r.cells, r.measured_at) == (3, 0.9, 1, 18, "2024-01-03")


def test_two_medians(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double")
    assert tuple(df.agg(stats.nearest_rank("v", 0.5), stats.interpolated("v")).first()) == (2.0, 2.5)


def test_circular_mean_crosses_north(spark):
    df = spark.createDataFrame([(350.0,), (10.0,)], "a double")
    m = df.agg(geo.circular_mean_deg(F.col("a"))).first()[0]
    assert min(m, 360 - m) < 1e-9


def test_asof_ties_tolerance_and_empty_side(spark):
    left = spark.createDataFrame([("k", 0, 10), ("k", 1, 15), ("k", 2, 99), ("none", 3, 5)], "key string, id int, t long")
    right = spark.createDataFrame([("k", 10, "b"), ("k", 10, "a"), ("k", 20, "c")], "key string, t long, v string")
    got = {r.id: (r.v, r.age) for r in asof.nearest(left, right, ["key"], "t", ["v"], "v", 30).collect()}
    assert got == {0: ("a", 0), 1: ("a", 5), 2: (None, 79), 3: (None, None)}


def test_distance_windows_share_their_border(spark):
    f = spark.createDataFrame([("s", float(d)) for d in range(101)], "session_id string, distance double")
    w = telemetry.distance_windows(f, 25.0, 1).orderBy("w").collect()
    assert [(r.start_m, r.end_m, r.frames) for r in w] == [(0, 25, 26), (25, 50, 26), (50, 75, 26), (75, 100, 26)]


def test_packing_is_greedy(spark):
    g = spark.createDataFrame([("s", k, n) for k, n in enumerate([5, 5, 5, 20, 1])], "s string, w int, n int")
    assert [r.pack for r in telemetry.pack(g, ["s"], "w", "n", 10).orderBy("w").collect()] == [0, 0, 1, 2, 3]


def test_marker_beyond_reach_is_null(spark):
    p = spark.createDataFrame([(1, -23.5, -46.6), (2, 10.0, 10.0)], "id int, lat double, lon double")
    m = spark.createDataFrame([("A", 1, -23.5001, -46.6), ("B", 2, -23.5001, -46.6)], "marker string, km int, mlat double, mlon double")
    assert {r.id: r.marker for r in places.nearest_marker(p, m, "id").collect()} == {1: "A", 2: None}


def test_runs_round_trip(spark):
    bits = spark.createDataFrame([("m", v) for v in (1, 2, 3, 7, 9, 10)], "m string, at long")
    runs = documents.rle_encode(bits, "m", "at")
    assert sorted((r.start, r["count"]) for r in runs.collect()) == [(1, 3), (7, 1), (9, 2)]
    assert sorted(r.at for r in documents.rle_decode(runs, "m", "at").collect()) == [1, 2, 3, 7, 9, 10]


def test_frame_readings_of_both_roots_and_of_garbage(spark):
    vote = lambda frame, samples, top: {"frameIndex": frame, "sampleCount": samples, "h95M": top}
    cells = [
        {"localGroundM": 0.3, "h95M": 1.0, "status": "measured", "evidenceFrameIndices": [4], "frameVotes": [vote(1, 12, 1.1), vote(4, 8, 0.5)]},
        {"localGroundM": 0.0, "h95M": 0.4, "status": "measured", "frameVotes": [vote(1, 20, 0.4)]},
        {"localGroundM": 0.05, "h95M": 0.3, "status": "measured", "evidenceFrameIndices": [1], "frameVotes": [vote(1, 5, 0.25)]},
    ]
    rows = [("a", json.dumps({"measurements": cells})), ("b", json.dumps({"assessment": {"measurements": cells}})), ("c", "garbage"), ("d", None)]
    found = documents.cells_of(spark.createDataFrame(rows, "k string, j string"), ["k"], "j")
    got = {(r.k, r.frame): r for r in documents.frame_readings(found, ["k"]).collect()}
    assert set(got) == {("a", 2), ("a", 5), ("b", 2), ("b", 5)}
    # Above their grounds frame 1 sees 0.8, 0.4 and 0.2 m; frame 4 only 0.2 m.
    r = got["a", 2]
    assert (r.cells, r.samples, r.evidence) == (3, 37, 1) and r.median_height == pytest.approx(0.4) and r.disagreement == pytest.approx(0.1)
    assert got["b", 5].max_height == pytest.approx(0.2) and got["b", 5].evidence == 1


def test_upsert_and_conflicts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, changes.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "x"), (3, "c")]
    merged, conflict = changes.insert_if_absent(old, new, ["k"], ["v"])
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "b"), (3, "c")] and [tuple(r) for r in conflict.collect()] == [(2, "x")]


def test_planes_do_not_depend_on_partitions(spark):
    random = np.random.default_rng(0)
    rows = [(1, k, float(x), float(0.1 * x + 0.02 * z + 1 + e), float(z), 1.0) for k, (x, z, e) in enumerate(zip(random.uniform(-5, 5, 300), random.uniform(-5, 5, 300), random.normal(0, 0.01, 300), strict=True))]
    p = spark.createDataFrame(rows, "g int, id int, x double, y double, z double, w double")
    a, b = (planes.fit_robust(p.repartition(n), "g", "id", gate=planes.Gate(trials=100)).first() for n in (1, 7))
    assert a[2:11] == pytest.approx(b[2:11], abs=1e-9)
    assert (-a.nx / a.ny, -a.nz / a.ny, -a.offset / a.ny) == pytest.approx((0.1, 0.02, 1.0), abs=0.01)
    assert tuple(cloud.plane_fit(p, ["g"]).first())[1:] == pytest.approx((0.1, 0.02, 1.0), abs=0.01)


def test_components_and_erosion(spark):
    v = spark.createDataFrame([("o", 0, 0, 0), ("o", 1, 1, 1), ("o", 5, 5, 5)], "o string, vx int, vy int, vz int")
    assert tuple(cloud.connected_voxels(v, "o").first())[1:] == (3, 2, pytest.approx(2 / 3))
    m = spark.createDataFrame([([1] * 25,)], "mask array<int>")
    assert sum(cloud.eroded(m, "mask", 5, 1).first().mask) == 9


def test_geojson_and_npz_sources(spark, tmp_path):
    (tmp_path / "m.geojson").write_text(json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [-46.6, -23.5]}, "properties": {"km": 3}}, {"geometry": {"type": "Point", "coordinates": [1]}, "properties": {}}]}))
    assert [tuple(r) for r in geojson.read_markers(spark, f"{tmp_path}/m.geojson", "R1").collect()] == [("R1", 3.0, -23.5, -46.6)]
    d = np.arange(12, dtype="<f4").reshape(2, 2, 3)
    np.savez(tmp_path / "run.npz", depth=d, confidence=d, intrinsics=np.zeros((2, 3, 3), "<f4"), extrinsics=np.zeros((2, 3, 4), "<f4"))
    got = npz.read_depth_runs(spark, str(tmp_path)).orderBy("frame").collect()
    assert [r.frame for r in got] == [0, 1] and got[1].depth == d[1].ravel().tolist() and (got[0].height, got[0].width) == (2, 3)


def test_stream_equals_batch_and_runs_once(spark, tmp_path):
    line = lambda s, w, a, **k: json.dumps({"session_id": s, "segment_id": 1, "window_index": w, "generation": "g", "attempt": a, "sent_at": "2024-01-01T00:00:00Z"} | k)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join([line(1, 0, 1), line(1, 0, 1), line(2, None, 1, windows=3), line(3, 0, 1), line(4, 0, 3), "broken"]))
    good, bad = messages.parse(messages.read(spark, str(tmp_path / "in")))
    work = lambda df: df.withColumn("failed", F.col("session_id") >= 3)
    out = {n: str(tmp_path / n) for n in ("done", "retry", "poison")}
    for _ in range(2):  # a restart finds its checkpoint and does nothing twice
        messages.process(messages.fan_out(messages.once(good)), work, **out, checkpoint=str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    rows = {n: sorted((r.session_id, r.window_index, r.attempt) for r in spark.read.parquet(p).collect()) for n, p in out.items()}
    assert rows == {"done": [(1, 0, 1), (2, 0, 1), (2, 1, 1), (2, 2, 1)], "retry": [(3, 0, 2)], "poison": [(4, 0, 3)]}


def test_markers_and_roads_are_found_far_north(spark):
    at = spark.createDataFrame([(1, 66.0, 10.009), (2, 12.5, 10.001), (3, 0.0, 0.0)], "id int, lat double, lon double")
    markers = spark.createDataFrame([("north", 1, 66.0, 10.0190)], "marker string, km int, mlat double, mlon double")
    got = {r.id: r for r in places.nearest_marker(at, markers, "id").collect()}
    assert got[1].marker == "north" and 450 < got[1].distance < 460 and got[3].marker is None
    roads = spark.createDataFrame([("long", 0, 10.0, 10.0), ("long", 1, 13.0, 10.0)], "road string, ord int, lat double, lon double")
    matched = {r.id: r for r in places.match_road(at, roads, "id").collect()}
    assert matched[2].road == "long" and abs(matched[2].distance - 108.7) < 1 and matched[1].road is None


def test_expected_levels_sittings_and_readiness_of_odd_rows(spark):
    from kerbside.operators import measures

    levels = spark.createDataFrame([("a", 0.9, 3), ("a", 1.1, 3), ("b", 5.0, 9)], "o string, level double, n int")
    wanted = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "o string, expected double")
    near = {r.o: r.level for r in measures.level_near(levels, wanted, ["o"]).collect()}
    assert near == {"a": 0.9, "b": None, "c": None}
    trials = spark.createDataFrame([("a", None, 1.0), ("a", None, 1.5), ("a", 7, 3.0), ("b", 1, 2.0), ("b", 1, None)], "o string, s int, v double")
    ranges = {r.o: (r.sittings, r.within, r.between) for r in measures.sitting_ranges(trials, "o", "s", "v").collect()}
    assert ranges == {"a": (2, 0.5, 1.75), "b": (1, None, None)}
    sessions = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 0)], "session_id int, last_index int")
    segments = spark.createDataFrame([(1, "ready"), (1, "ready"), (2, "ready"), (3, "ready")], "session_id int, state string")
    states = {r.session_id: r.state for r in measures.readiness(sessions, segments).collect()}
    assert states == {1: "ready", 2: "processing", 3: "processing", 4: "waiting"}


def test_an_objects_voxels_join_over_any_length_and_repeats_count_once(spark):
    from kerbside.operators import cloud

    rows = [("long", k, k % 2, 0) for k in range(40)] + [("long", 0, 0, 0), (None, 1, 1, 1), (None, 5, 1, 1)]
    found = {r.o: (r.voxels, r.components, r.largest_share) for r in cloud.connected_voxels(spark.createDataFrame(rows, "o string, vx int, vy int, vz int"), "o").collect()}
    assert found == {"long": (40, 1, 1.0), None: (2, 2, 0.5)}


def test_media_facts_of_odd_probes(spark):
    from kerbside.operators import media

    good = '{"streams":[{"width":640,"height":480,"avg_frame_rate":"30000/1001","tags":{"rotate":"-90"}}],"format":{"duration":"2.5"}}'
    rows = [(1, good), (2, None), (3, "no json"), (4, good.replace("2.5", "NaN")), (5, good.replace("30000/1001", "30")), (6, good.replace("1001", "0"))]
    got = {r["k"]: r for r in media.media_facts(spark.createDataFrame(rows, "k int, json string"), ["k"], "json").collect()}
    assert (got[1]["width"], got[1]["height"], got[1]["rotation"], round(got[1]["rate"], 3)) == (480, 640, 270, 29.97)
    assert [got[k]["fault"] for k in range(1, 7)] == [None, "no stream", "no stream", "no duration or size", None, None]
    assert got[5]["rate"] == got[6]["rate"] == 0


def test_frame_timeline_starts_at_its_first_frame(spark):
    from kerbside.operators import media

    frames = lambda *t: '{"frames":[' + ",".join(f'{{"best_effort_timestamp_time":"{x}","key_frame":1}}' for x in t) + "]}"
    rows = [(1, frames("1.5", "1.5", "1.54")), (2, frames("2", "1.9")), (3, None), (4, frames("0", "x"))]
    got = {}
    for r in media.frame_timeline(spark.createDataFrame(rows, "k int, json string"), ["k"], "json").orderBy("k", "frame").collect():
        got.setdefault(r["k"], []).append((r["at_ns"], r["fault"]))
    assert got[1] == [(0, None), (0, None), (40000000, None)]
    assert got[2] == [(None, "time runs backwards")] * 2
    assert got[3] == [(None, "no frames")]
    assert got[4] == [(None, "invalid time")] * 2


def test_claims_hold_until_they_run_out(spark):
    from kerbside.operators import claims

    rows = [("a", 0, 1), ("a", 10, 2), ("a", 11, 3), ("a", 11, 4), ("a", None, 5), ("b", 7, 6)]
    got = claims.claims(spark.createDataFrame(rows, "k string, at long, n int"), ["k"], "at", "n", 10).collect()
    assert {r["n"]: r["fate"] for r in got} == {1: "taken", 2: "held", 3: "expired", 4: "held", 6: "taken"}
    assert claims.claims(spark.createDataFrame([], "k string, at long, n int"), ["k"], "at", "n", 10).count() == 0


def test_vectors_without_direction(spark):
    from kerbside.functions import vectors

    df = spark.createDataFrame([(0.0, 0.0, 0.0), (0.0, 0.0, 2.0), (None, 1.0, 0.0)], "x double, y double, z double")
    a = vectors.vector(F.col("x"), F.col("y"), F.col("z"))
    up = vectors.vector(F.lit(0), F.lit(0), F.lit(1))
    none, along, unknown = df.select(vectors.unit(a).alias("u"), vectors.angle_deg(a, up).alias("d"), vectors.across(a).alias("s")).collect()
    assert none["u"] is None and none["d"] is None and none["s"]["first"] is None
    assert tuple(along["u"]) == (0, 0, 1) and along["d"] == 0
    assert tuple(along["s"]["first"]) == (0, -1, 0) and tuple(along["s"]["second"]) == (1, 0, 0)
    assert unknown["u"] is None


def test_labels_fall_back(spark):
    from kerbside.functions import labels

    rows = [("BR", 3, "Elm", 1.0, 2.0), (" ", 3, "Elm", 1.0, 2.0), (None, None, "", 1.5, -2.25), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "road string, km int, street string, lat double, lon double")
    got = [r[0] for r in df.select(labels.place_label(*(F.col(c) for c in df.columns))).collect()]
    assert got == ["BR km 3", "Elm", "1.50000, -2.25000", None]
    sizes = spark.createDataFrame([([],), (["a"],), (["a", "b", "c"],)], "l array<string>")
    assert [r[0] for r in sizes.select(labels.places_label(F.col("l"))).collect()] == [None, "a", "a and 2 more"]


def test_halves_are_rounded_as_sql_rounds_doubles(spark):
    import duckdb

    odd = [48.714663815499996, -49.632494819499996, 45.292156167499996, 0.0, -1.5e-9, float("inf"), None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(odd)], "k int, v double")
    got = [r.w for r in df.select("k", stats.rounded(F.col("v"), 9).alias("w")).orderBy("k").collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 9)", [v]).fetchone()[0] for v in odd]
    assert got[0] == 48.714663816


def test_large_doubles_are_rounded_as_sql_rounds_them(spark):
    import duckdb

    odd = [9779951100.564025, 9779951103.410909, 4600000000.000001, -4600000000.000003, 136919316.4965475, 3.9e12 + 0.123, -2.5e13, 1e300, 1.7e308, 0.49999949999999997, 1.5e-6, 2.5e-6]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(odd)], "k int, v double")
    got = [r.w for r in df.select("k", stats.rounded(F.col("v"), 6).alias("w")).orderBy("k").collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in odd]


def test_frame_readings_read_the_cells_once(spark, capsys):
    vote = "struct<frameIndex: int, sampleCount: bigint, h95M: double>"
    rows = [(1, 0, 0.5, 1.0, [0, 2], [(0, 3, 1.5)]), (1, 1, 0.5, None, None, [(0, 2, 2.0)]), (1, 2, 0.5, 1.0, [2], None)]
    found = spark.createDataFrame(rows, f"k int, cell int, localGroundM double, h95M double, evidenceFrameIndices array<int>, frameVotes array<{vote}>")
    out = documents.frame_readings(found, ["k"])
    out.explain()
    assert capsys.readouterr().out.count("Scan ExistingRDD") == 1
    assert sorted(map(tuple, out.collect())) == [(1, 1, 2, 5, 1.25, 1.5, 0.5, 1), (1, 3, 0, 0, None, None, None, 2)]
