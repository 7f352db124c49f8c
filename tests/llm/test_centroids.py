"""Clusters against Lloyd's rounds written plainly, bounds against all distances, and odd rows."""

from hashlib import sha256
from math import floor, inf, isfinite, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.llm import centroids


def plain(rows, k, rounds, dims):
    """Lloyd's rounds in whole numbers: (key, cluster, distance, centroid) of each kept row."""
    kept = [(i, tuple(floor(256 * x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        held = [nearest(v)[1] for _, v in kept]
        for n in range(len(cents)):
            own = [v for (_, v), h in zip(kept, held, strict=True) if h == n]
            if own:
                cents[n] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    found = [(i, *nearest(v)) for i, v in kept]
    return sorted(repr((i, n, d, sum(x[1] for x in found if x[2] == n), sum(x[1] for x in found), sha256(",".join(map(str, cents[n])).encode()).hexdigest())) for i, d, n in found)


def told(df):
    return sorted(repr(tuple(r)) for r in df.select("vec_id", *centroids.NEW).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize(("k", "scale"), [(12, 1.0), (12, 20000.0), (3, 0.01), (1, 1.0)])
def test_clusters_equal_plain_rounds(spark, k, scale):
    dice = np.random.default_rng(k)
    centres = dice.normal(size=(9, 4)) * 3
    rows = [(i, (scale * (centres[i % 9] + dice.normal(size=4) * 0.5)).tolist()) for i in range(400)] + [(1000 + i, [0.5 * scale] * 4) for i in range(60)]
    out, model = centroids.cluster(frame(spark, rows).repartition(3), k=k, rounds=5, dims=4)
    assert told(out) == plain(rows, k, 5, 4)
    if k == 12:
        assert model.rounds[0][2] == 12 * 460
        assert sum(worked for _, _, worked in model.rounds[1:]) < 0.75 * 4 * 12 * 460, model.rounds
        assert model.rounds[-1][0] <= model.rounds[0][0] == 3


def test_bounds_hold_and_change_nothing():
    dice = np.random.default_rng(5)
    q = dice.integers(-40, 40, size=(500, 3))
    cents = q[:20].copy()
    state, moved = centroids.scan(q, cents, 5), None
    for b in (5, 5, 3, 3):
        new = cents + dice.integers(-3, 4, size=cents.shape) * (dice.random((20, 1)) < 0.6)
        moved, cents = centroids.above(centroids.some_squares(new, cents)), new
        state = centroids.follow(q, state, cents, moved, b)
        squares = ((q[:, None] - cents) ** 2).sum(2)
        assert (state.cluster == squares.argmin(axis=1)).all()
        true = np.sqrt(squares)
        at = np.arange(500)
        assert (state.upper >= true[at, state.cluster]).all() and (state.lows <= true[at[:, None], state.ids]).all()
        outside = true.copy()
        outside[at, state.cluster] = inf
        np.put_along_axis(outside, state.ids, inf, axis=1)
        assert (state.rest <= outside.min(axis=1)).all()
        assert all(len({c, *i}) == 1 + b for c, i in zip(state.cluster, state.ids, strict=True))


def test_squares_are_exact_at_any_size():
    dice = np.random.default_rng(1)
    for most in (100, 1 << 20, centroids.MOST):
        q, c = dice.integers(-most, most, size=(20, 64)), dice.integers(-most, most, size=(4, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in q]
        assert centroids.all_squares(q, c).tolist() == want


def test_odd_rows(spark):
    rows = [(1, None), (2, [1.0]), (3, [1.0, None]), (4, [1.0, nan]), (5, [inf, 0.0]), (6, [1.0, -2.0]), (6, [1.0, -2.0]), (None, [0.001, -0.001]), (8, [7.0, 7.0]), (9, [4.0, 2.5]), (9, [2.5, 4.0])]
    df = frame(spark, rows).withColumn("_v", F.lit("x")).withColumn("_0", F.lit(1))
    for k in (2, 40):
        out, _ = centroids.cluster(df, k=k, dims=2)
        assert told(out) == plain(rows, k, 5, 2)
    out, _ = centroids.cluster(df, k=2, dims=2, keep=["_0", "vec_id", "_v"])
    assert out.columns == ["_0", "vec_id", "_v", *centroids.NEW]
    assert {(r["_0"], r["_v"]) for r in out.collect()} == {(1, "x")}
    with pytest.raises(ValueError, match="in the way"):
        centroids.cluster(df.withColumn("distance", F.lit(1)), dims=2, keep=["distance"])
    out, model = centroids.cluster(frame(spark, rows[:5]), dims=2)
    assert out.count() == 0 and model.rounds == [] and out.columns == ["vec_id", *centroids.NEW]
    far, _ = centroids.cluster(frame(spark, [(1, [1e300, -1e300]), (2, [0.0, 0.0])]), k=1, dims=2)
    assert far.count() == 2  # saturated
