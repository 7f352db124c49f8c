"""The scan against one fold along each session."""

import math
import random

import numpy as np
import pytest

from kerbside.operators import orientation


def fold(rows, most=0.25):
    out = {}
    for session in {r[0] for r in rows}:
        q, last = (0.0, 0.0, 0.0, 1.0), None
        for _, key, t, *rate in sorted((r for r in rows if r[0] == session), key=lambda r: (r[2], r[1])):
            dt = 0.0 if last is None else (t - last) / 1e9
            if 0 < dt <= most and all(v is not None and math.isfinite(v) for v in rate):
                (x, y, z, w), (a, b, c) = q, (v * dt / 2 for v in rate)
                n = (x + w * a + y * c - z * b, y + w * b + z * a - x * c, z + w * c + x * b - y * a, w - x * a - y * b - z * c)
                size = math.sqrt(sum(v * v for v in n))
                q = tuple(v / size for v in n)
            last = t
            out[session, key] = q
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_the_scan_equals_one_fold(spark, seed):
    d, rows = random.Random(seed), []
    for session, n in ((1, 3000), (2, 40), (3, 1)):
        t = 0
        for k in range(n):
            t += d.choice([0, 5_000_000, 20_000_000, 90_000_000, 260_000_000 if d.random() < 0.1 else 10_000_000])
            rows.append((session, k, t, d.gauss(0, 3), d.gauss(0, 3), d.choice([d.gauss(0, 3), None, float("nan"), float("inf")]) if d.random() < 0.1 else d.gauss(0, 3)))
    d.shuffle(rows)
    odd = [(None, 1, 0, 1.0, 1.0, 1.0), (1, -1, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows + odd, "session long, k long, t long, rx double, ry double, rz double")
    got = {(r.session, r.k): (r.qx, r.qy, r.qz, r.qw) for r in orientation.orientations(df, "session", "k").collect()}
    want = fold(rows)
    assert got.keys() == want.keys()
    assert max(abs(a - b) for k in want for a, b in zip(got[k], want[k], strict=True)) < 1e-9


def test_running_products_equal_products_in_turn():
    q = np.random.default_rng(0).normal(size=(37, 4))
    now = q[0] / np.linalg.norm(q[0])
    got = orientation.running(q)
    for k in range(1, 37):
        now = orientation.product(now[None], q[k : k + 1])[0]
        assert got[k] == pytest.approx(now, abs=1e-12)


def test_no_samples(spark):
    assert orientation.orientations(spark.createDataFrame([], "session long, k long, t long, rx double, ry double, rz double"), "session", "k").count() == 0
