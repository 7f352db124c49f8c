"""Canonical JSON against a plain writer; orders keep the evidence they were opened on; bounded strides."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from kerbside.functions.canonical import canonical_json
from kerbside.operators import cloud, places, work


def number(x):
    """A double as scripts in browsers write it, from its fewest digits."""
    if x == 0:
        return "0"
    m, _, e = repr(abs(float(x))).lower().partition("e")
    whole, _, part = m.partition(".")
    digits = whole + part.rstrip("0")
    point = len(whole) + int(e or 0)
    point -= len(digits) - len(digits.lstrip("0"))
    digits = digits.lstrip("0").rstrip("0")
    k = len(digits)
    if k <= point <= 21:
        text = digits + "0" * (point - k)
    elif 0 < point <= 21:
        text = digits[:point] + "." + digits[point:]
    elif -6 < point <= 0:
        text = "0." + "0" * -point + digits
    else:
        text = digits[0] + ("." + digits[1:] if k > 1 else "") + f"e{point - 1:+d}"
    return "-" * (x < 0) + text


def canonical(v):
    if isinstance(v, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(v[k])}" for k in sorted(v, key=lambda k: k.encode())) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(canonical, v)) + "]"
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    return number(float(v))


def made(d, depth=0):
    kind = d.randrange(9 if depth < 3 else 7)
    if kind == 7:
        return [made(d, depth + 1) for _ in range(d.randrange(4))]
    if kind == 8:
        return {d.choice(["a", "b", "é", "z\"", "10", "9", "key with blanks", ""]) + str(k): made(d, depth + 1) for k in range(d.randrange(4))}
    return [None, True, False, d.choice(["", "x\\\"y", "1.50", "a: 1, {b}", "tab\tend\n", "é€😀"]), d.randint(-(10**6), 10**6), d.uniform(-1, 1) * 10.0 ** d.randint(-12, 25), d.choice([0.1, -0.0, 1e21, 123456789012345680000.0, 1e-6, 1.5e-7, 8.41e21, 2e23, 1.7976931348623157e308, 100.0])][kind]


def shuffled(v, d):
    if isinstance(v, dict):
        keys = list(v)
        d.shuffle(keys)
        return {k: shuffled(v[k], d) for k in keys}
    return [shuffled(x, d) for x in v] if isinstance(v, list) else v


def test_canonical_json_is_one_text(spark):
    d = random.Random(11)
    values = [made(d) for _ in range(300)] + [{"b": {"d": 2.5, "c": [1]}, "a": 1}]
    rows = [(k, json.dumps(shuffled(v, d), ensure_ascii=d.random() < 0.5, indent=d.choice([None, 2]))) for k, v in enumerate(values) for _ in range(2)]
    got = spark.createDataFrame(rows, "k int, t string").select("k", canonical_json(F.col("t")).alias("c")).collect()
    for r in got:
        assert r.c == canonical(values[r.k])
    bad = ["{", "", "NaN", '{"a":1,"a":2}', "[1e400]", "[-1e999, 1]", None]
    assert {r[0] for r in spark.createDataFrame([(b,) for b in bad], "t string").select(canonical_json(F.col("t"))).collect()} == {None}
    assert spark.createDataFrame([('["1e400"]',)], "t string").select(canonical_json(F.col("t"))).first()[0] == '["1e400"]'


def test_an_opened_order_is_frozen(spark):
    drafts = spark.createDataFrame([(1, "t1"), (2, "t2"), (3, "t3")], "order_id long, opened_at string")
    targets = spark.createDataFrame([(1, 1, 7, 70, None), (1, 2, 7, 71, 4), (2, 1, 8, 80, None)], "order_id long, position int, session_id long, segment_id long, window_index int")
    columns = "session_id long, segment_id long, window_index int, level int, place string, start_m double, end_m double, lat double, lon double"
    readings = spark.createDataFrame([(7, 70, None, 2, "first", 10.0, 30.0, 1.0, 2.0), (7, 71, 4, 3, "second", None, 5.0, None, None), (8, 80, 1, 3, "other", 0.0, 1.0, 0.0, 0.0)], columns)
    orders, events, faults = work.opened(drafts, targets, readings)
    (o,) = orders.collect()
    assert (o.order_id, o.area_m2, o.worst, o.lat, o.lon, o.n_targets, o.place, o.status) == (1, 1700.0, 3, 1.0, 2.0, 2, "first", "open")
    assert [tuple(r) for r in events.collect()] == [(1, "t1", "open", None)]
    assert [(r.order_id, r.segment_id) for r in faults.collect()] == [(2, 80)]  # its window was measured, not the segment
    page = work.with_history(orders.select("order_id"), events.withColumn("event_id", F.lit(1)))
    assert [len(r.events) for r in page.collect()] == [1]
    assert work.with_history(drafts.select("order_id"), events.where("false").withColumn("event_id", F.lit(1))).where("size(events) = 0").count() == 3


@pytest.mark.parametrize(("n", "most"), [(59, 30), (30, 30), (31, 30), (1, 5), (100, 7)])
def test_a_stride_keeps_its_bound(spark, n, most):
    rows = spark.range(n).select("id", F.lit(1).alias("g"))
    kept = [r.id for r in cloud.strided(rows, ["g"], "id", most).orderBy("id").collect()]
    assert len(kept) <= most and kept == list(range(0, n, math.ceil(n / most)))


def test_places_on_a_road(spark):
    anchors = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 0.0, 0.01), (3.0, 0.02, 0.01)], "km double, lat double, lon double")
    road = {round(r.km, 1): (round(r.lat, 6), round(r.lon, 6)) for r in places.sampled_road(anchors).collect()}
    assert len(road) == 31 and road[0.5] == (0.0, 0.005) and road[2.0] == (0.01, 0.01) and road[3.0] == (0.02, 0.01)
    at = spark.createDataFrame([(1, 0.0001, 0.0052), (2, 5.0, -6.0), (3, None, 1.0)], "k int, lat double, lon double")
    got = {r.k: r for r in places.described(at, anchors, "Ring").collect()}
    assert got[1].label == "Ring · KM 0.5" and got[1].on_road and got[1].distance_km < 0.03
    assert got[2].label == "5.0000° N · 6.0000° W" and not got[2].on_road and got[2].km is None and got[2].distance_km > 500
    assert got[3].label is None and got[3].distance_km is None
