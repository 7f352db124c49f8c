"""Vectors of three numbers, as structs of x, y and z."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: vectors no longer than this have no direction.
LEAST = 1e-12
AXES = ("x", "y", "z")


def vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once: nested vectors would else be written out many times over."""
    return F.transform(F.array(value), f)[0]


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda v: _cross(v["a"], v["b"]))


def _cross(a: Column, b: Column) -> Column:
    return vector(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def unit(a: Column) -> Column:
    """The vector's direction; null for one without."""
    return let(a, lambda v: F.when(dot(v, v) > LEAST * LEAST, vector(*(v[c] / F.sqrt(dot(v, v)) for c in AXES))))


def angle_deg(a: Column, b: Column) -> Column:
    """Degrees between two directions; null if either has none."""
    cosine = let(F.struct(unit(a).alias("a"), unit(b).alias("b")), lambda v: dot(v["a"], v["b"]))
    return F.degrees(F.acos(F.when(cosine > 1, 1.0).when(cosine < -1, -1.0).otherwise(cosine)))


def seed(w: Column) -> Column:
    """The axis that a direction follows least, the earlier of equals."""
    x, y, z = (F.abs(w[c]) for c in AXES)
    one = lambda *at: vector(*map(F.lit, at))
    return F.when((x <= y) & (x <= z), one(1, 0, 0)).when(y <= z, one(0, 1, 0)).otherwise(one(0, 0, 1))


def across(up: Column) -> Column:
    """Two directions (first, second) that stand on `up` and on each other; null parts if `up` has no direction."""
    first = let(unit(up), lambda w: F.struct(w.alias("w"), unit(cross(seed(w), w)).alias("f")))
    return let(first, lambda v: F.struct(v["f"].alias("first"), unit(cross(v["w"], v["f"])).alias("second")))


def elevation_at(normal: Column, offset: Column, place: Column, up: Column) -> Column:
    """How high along `up` a plane lies under a place; null for a plane that `up` runs along."""
    def over(axis: Column) -> Column:
        rise = dot(normal, axis)
        return F.when(F.abs(rise) >= 1e-9, dot(place, axis) - (dot(normal, place) + offset) / rise)

    return let(unit(up), over)


def transformed(m: Column, v: Column) -> Column:
    """A place moved by a row-major 4 x 4 matrix (an array of 16): the last row only scales; null for a scale of 0."""
    row = lambda k: m[4 * k] * v["x"] + m[4 * k + 1] * v["y"] + m[4 * k + 2] * v["z"] + m[4 * k + 3]
    scale = F.when(row(3) != 0, row(3))
    return vector(*(row(k) / scale for k in range(3)))


def matrix_product(a: Column, b: Column) -> Column:
    """a b of two row-major 4 x 4 matrices."""
    return F.array(*(sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j]) for i in range(4) for j in range(4)))


def camera_centre(e: Column) -> Column:
    """Where a camera stands: -R^T t of its row-major 3 x 4 or 4 x 4 matrix from the world."""
    return vector(*(-(e[j] * e[3] + e[4 + j] * e[7] + e[8 + j] * e[11]) for j in range(3)))


def scaled_about(centre: Column, factor: Column) -> Column:
    """The row-major 4 x 4 matrix that scales by a factor about a place."""
    rows = [[factor if i == j else F.lit(0.0) for j in range(3)] + [centre[c] * (1 - factor)] for i, c in enumerate(AXES)]
    return F.array(*(x for r in rows for x in r), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def turned(m: Column, direction: Column) -> Column:
    """A direction under a row-major 4 x 4 matrix's turn, of length 1; null if it has none."""
    row = lambda k: m[4 * k] * direction["x"] + m[4 * k + 1] * direction["y"] + m[4 * k + 2] * direction["z"]
    return unit(vector(row(0), row(1), row(2)))
