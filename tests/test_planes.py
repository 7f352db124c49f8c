"""Ground planes of made scenes: the floor wins over a larger table, whatever the seed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import planes

GATE = planes.Gate(trials=150)
COLUMNS = "g string, id long, x double, y double, z double, w double"


def scene(g, tilt=0.0, floor=600, table=900, wall=500, seed=0):
    """A floor through the origin that rises along x, a larger table 0.75 above it, and a wall."""
    d = np.random.default_rng(seed)
    rows = []
    for n, high in ((floor, 0.0), (table, 0.75)):
        x, z = d.uniform(-2, 2, n), d.uniform(-2, 2, n)
        rows += list(zip(x, high + tilt * x + d.normal(0, 0.005, n), z))
    rows += list(zip(np.full(wall, 2.0) + d.normal(0, 0.005, wall), d.uniform(0, 2, wall), d.uniform(-2, 2, wall)))
    return [(g, k, *map(float, r), 1.0) for k, r in enumerate(rows)]


@pytest.fixture(scope="module")
def scenes(spark):
    rows = scene("level") + scene("sloped", 0.2, seed=1) + [("few", 1, 0.0, 0.0, 0.0, 1.0), ("few", 2, 1.0, 0.0, 0.0, 1.0)] + [("line", k, float(k), 0.0, 0.0, 1.0) for k in range(50)]
    rows += [("level", 10**6 + k, float("nan") if k else None, 1.0, 1.0, 1.0) for k in range(2)] + [("level", 10**7, float("inf"), 0.0, 0.0, 1.0)]
    return spark.createDataFrame(rows, COLUMNS).cache()


def test_the_floor_wins_over_a_larger_table_for_any_seed(scenes):
    for seed in (1, 2, 3):
        found = {r.g: r for r in planes.fit_robust(scenes, "g", "id", gate=GATE._replace(seed=seed)).collect()}
        for g, rise in (("level", 0.0), ("sloped", 0.2)):
            r = found[g]
            assert r.failure is None and abs(r.offset) < 0.01 and -r.nx / r.ny == pytest.approx(rise, abs=0.01)
            assert 550 < r.inliers < 700 and r.rmse < 0.01 and r.below_share < 0.06  # the wall reaches under a slope
        assert found["sloped"].tilt_deg == pytest.approx(np.degrees(np.arctan(0.2)), abs=0.5)
        assert found["few"].failure == "100%: fewer than three points | 35%: fewer than three points"
        assert found["line"].failure.startswith("100%: no plane within the tilt") and found["line"].nx is None


def test_gates_refuse(scenes):
    pools = {(r.g, r.pool): r for r in planes.fit_pools(scenes, "g", "id", (1.0, 0.0, 0.0), GATE._replace(most_tilt=20.0, most_below=0.1)).collect()}
    assert pools["level", 1.0].failure == "too much of the cloud lies below"  # the wall, seen from its back
    none = planes.fit_pools(scenes, "g", "id", gate=GATE._replace(least_inliers=10**6)).where("g = 'level'").collect()
    assert {r.failure for r in none} == {"no plane has enough inliers"}
    thin = planes.fit_robust(scenes, "g", "id", gate=GATE._replace(least_share=0.5)).where("g = 'level'").first()
    assert thin.failure == "too thin" and thin.nx is not None


def test_weights_veto_a_surface(scenes):
    veto = scenes.withColumn("w", F.when(F.abs("y") < 0.1, 0.0).otherwise(1.0))
    r = planes.fit_robust(veto.where("g = 'level'"), "g", "id", gate=GATE._replace(most_below=1.0, below_scale=10.0)).first()
    assert r.offset == pytest.approx(-0.75, abs=0.01)


def test_a_second_pass_and_seeds(spark, scenes):
    first, again = planes.fit_twice(scenes.where("g = 'sloped'"), "g", "id", gate=GATE)
    a, b = first.first(), again.first()
    assert a.tilt_deg > 10 and b.tilt_deg < 1 and b.failure is None and b.offset == pytest.approx(a.offset, abs=0.005)
    marks = [("level", k, x, 0.75 + 0.01 * k, z) for k, (x, z) in enumerate([(-1.0, -1.0), (1.0, -1.0), (0.0, 1.0)])] + [("sloped", 1, 0.0, 0.0, 0.0)] + [("line", k, float(k), 0.0, 0.0) for k in range(3)]
    hand = {r.g: r for r in planes.fit_seeded(scenes, spark.createDataFrame(marks, "g string, id long, x double, y double, z double"), "g", "id", gate=GATE._replace(band=0.03)).collect()}
    assert hand["level"].offset == pytest.approx(-0.75, abs=0.01) and hand["level"].failure is None
    assert hand["sloped"].failure == "fewer than three seeds" and hand["line"].failure == "seeds in a line"


def test_least_hashes_take_any_number(spark):
    df = spark.range(5000).select("id", (F.col("id") % 2).alias("g"))
    some = [{r.id for r in planes.least_hashes(df.repartition(n), ["g"], "id", most, 3).collect()} for n, most in ((1, 900), (6, 900), (3, 1500))]
    assert some[0] == some[1] and len(some[0]) == 1800 and some[0] < some[2] and len(some[2]) == 3000


def test_no_points_no_planes(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert planes.fit_robust(empty, "g", "id").count() == 0
