"""Groups of stops against one fold over each whole road; pairs of places against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from kerbside.operators import places, routes

COLUMNS = "road string, stop_id long, km double, lat double, lon double"


def roads(seed, spacing):
    dice, rows = random.Random(seed), []
    for r in ("a", "b", None):
        km = 0.0
        for k in range(150):
            km += dice.choice([0.0, spacing, 2 * spacing, 6.0 if dice.random() < 0.05 else spacing])
            rows.append((r, k + 1000 * len(rows), km, -23.0 + km / 111 + dice.gauss(0, 0.001), -46.0 + dice.gauss(0, 0.003)))
    return rows


@pytest.mark.parametrize(("seed", "spacing"), [(1, 0.3), (2, 0.9), (3, 0.05)])
def test_groups_equal_one_fold(spark, seed, spacing):
    rows = roads(seed, spacing)
    want = []
    for road in ("a", "b", None):
        own = sorted(r[2:3] + r[1:2] + r[3:] for r in rows if r[0] == road)
        want += [(road, *g) for g in routes.fold(own, len(own), set())]
    odd = [("a", None, 1.0, -23.0, -46.0), ("a", 10**9, None, -23.0, -46.0), ("a", 10**9 + 1, 1.0, None, -46.0)]
    dice = random.Random(seed)
    dice.shuffle(rows)
    got = routes.groups(spark.createDataFrame(rows + odd, COLUMNS).where("road IS NOT NULL"), "road")
    assert sorted(map(tuple, got.collect())) == sorted(w for w in want if w[0])
    assert len(want) > 30


def test_a_group_is_handed_over_from_stretch_to_stretch(spark):
    """A chain of stops 1 km apart: groups of two cross every border, so each stretch waits for the one before."""
    rows = [("r", k, k * 1.0, k / 111.2, 0.0) for k in range(60)]
    got = sorted((r.anchor, r.stop_id) for r in routes.groups(spark.createDataFrame(rows, COLUMNS), "road").where("place = 1").collect())
    assert got == [(k, k + 1) for k in range(0, 60, 2)]
    assert routes.groups(spark.createDataFrame([], COLUMNS), "road").count() == 0


def test_suggestions_are_ordered(spark):
    stops = spark.createDataFrame([("r", 1, 0.0, 0.0, 0.0, 2, 5.0, "x"), ("r", 2, 0.5, 0.0045, 0.0, 3, None, "x"), ("r", 3, 50.0, 0.45, 0.0, 3, 9.0, "x"), ("r", 4, 50.1, 0.451, 0.0, 2, 1.0, None), ("r", 5, 90.0, 0.8, 0.0, 3, 1.0, "x"), ("r", 6, 0.1, 0.001, 0.0, 1, 1.0, "x")], COLUMNS + ", level int, area_m2 double, equipment string")
    left = routes.candidates(stops, spark.createDataFrame([(5,)], "stop_id long"))
    out = routes.suggestions(routes.groups(left, "road"), stops, "road").collect()
    assert [(r.anchor, r.stops, r.level, r.area_m2, r.same_equipment) for r in out] == [(3, [3, 4], 3, 10.0, False), (1, [1, 2], 3, 5.0, True)]


def test_pairs_equal_all_pairs(spark):
    dice = random.Random(4)
    rows = [(f"r{k % 2}", k, dice.uniform(0, 12), dice.choice([0.0, -60.0, 80.0]) + dice.gauss(0, 0.01), (dice.choice([179.99, 10.0]) + dice.gauss(0, 0.01) + 180) % 360 - 180) for k in range(240)]
    df = spark.createDataFrame(rows, COLUMNS)
    for road in (None, "road"):
        got = {(r.a, r.b) for r in places.neighbour_pairs(df, "stop_id", road=road).collect()}
        want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and abs(a[2] - b[2]) <= 4.5 and routes.apart_km(a[3:], b[3:]) <= 1.5 and (road is None or a[0] == b[0])}
        assert got == want and len(want) > 200


def test_keys_of_one_spot_are_paired_over_all_their_parts(spark, monkeypatch):
    monkeypatch.setattr(places, "KEYS_IN_ROW", 3)
    rows = [("r", k, 0.5 * (k % 3), -23.0 + 0.0045 * (k % 3), -46.0) for k in range(60)] + [("r", 99, None, -23.0, -46.0)]
    out = places.neighbour_pairs(spark.createDataFrame(rows, COLUMNS), "stop_id", digits=3).collect()
    got = sorted((r.a, r.b, r.distance) for r in out)
    assert got == [(a, b, round(1000 * routes.apart_km(rows[a][3:], rows[b][3:]), 3)) for a in range(60) for b in range(a + 1, 60)]


def test_pairs_of_two_parts_are_not_held_at_once(spark):
    """What is exploded first is no part of the generated code that makes the pairs."""
    rows = [("r", k, 0.5 * (k % 3), -23.0 + 0.0045 * (k % 3), -46.0) for k in range(60)]
    out = places.neighbour_pairs(spark.createDataFrame(rows, COLUMNS), "stop_id")
    assert len(out.collect()) == 60 * 59 / 2
    first, last = (next(line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode(" in line and made in line) for made in ("[_x#", "[_y#"))
    assert "*(" in last and "*(" not in first


def test_the_nearest_marker_has_no_limit(spark):
    markers = spark.createDataFrame([("M", 3, 0.0, 0.0), ("N", 1, 0.0, 0.0), ("O", 7, 10.0, 10.0)], "marker string, km int, mlat double, mlon double")
    out = places.nearest_of_all(spark.createDataFrame([(1, 1.0, 1.0), (2, 60.0, 60.0)], "k int, lat double, lon double"), markers).orderBy("k").collect()
    assert [(r.marker, r.km) for r in out] == [("N", 1), ("O", 7)]
    assert places.nearest_of_all(spark.range(1).select("id", F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon")), markers.where("km > 99")).first().km is None


def test_the_nearest_marker_by_small_cells_is_that_of_all(spark, monkeypatch):
    dice = random.Random(5)
    posts = [("M", k, 0.001 * (k // 2) - 0.02, 0.002 * (k % 7)) for k in range(60)]
    rows = [(k, dice.gauss(0, 0.03), dice.gauss(0, 0.03)) for k in range(300)] + [(1000, 89.9, 10.0), (1001, -60.0, 179.0), (1002, None, 1.0)]
    made = lambda: {r.k: (r.km, r.distance) for r in places.nearest_of_all(spark.createDataFrame(rows, "k int, lat double, lon double"), spark.createDataFrame(posts, "marker string, km int, mlat double, mlon double")).collect()}
    got = made()
    want = {k: min((round(1000 * routes.apart_km((lat, lon), p[2:]), 6), p[1]) for p in posts) for k, lat, lon in rows[:-1]}
    assert all(got[k] == (w[1], pytest.approx(w[0], abs=2e-6)) for k, w in want.items()) and got[1002] == (0, None)
    monkeypatch.setattr(places, "SMALL_CELL_SLACK_M", float("inf"))  # every marker is measured
    assert made() == got
