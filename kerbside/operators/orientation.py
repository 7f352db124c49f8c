"""Relative orientation along rotation rates, by an associative scan.

A step turns the orientation q into q (x) s, s = (w dt / 2, 1), made a unit again. Products of quaternions do
not commute, but they associate, and length plays no part until the end. So pieces of a session, dealt
out by time, are multiplied up at the same time; what lies before a piece is the product of the pieces
before it and of the steps between them, some few for each task; one more product gives every sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.operators.stages import cut
from kerbside.session import ship_package

#: Fixed value: a longer gap between two samples turns nothing.
MOST_GAP_S = 0.25
PARTS = ("qx", "qy", "qz", "qw")
STILL = np.array([0.0, 0.0, 0.0, 1.0])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unit products of quaternions (x, y, z, w), row by row."""
    (ax, ay, az, aw), (bx, by, bz, bw) = a.T, b.T
    q = np.stack([aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz], axis=-1)
    return q / np.linalg.norm(q, axis=-1, keepdims=True)


def steps(t: np.ndarray, before: np.ndarray, rates: np.ndarray, most_gap_s: float) -> np.ndarray:
    """The step that leads to each sample from the one before it; none over a gap, or by rates that are no numbers."""
    with np.errstate(invalid="ignore", over="ignore"):
        dt = (t - before) / 1e9
        half = rates * (dt / 2)[:, None]
        size = np.sqrt(1 + (half * half).sum(axis=1))
    moves = (dt > 0) & (dt <= most_gap_s) & np.isfinite(size)
    return np.where(moves[:, None], np.column_stack([half, np.ones(len(t))]) / np.where(moves, size, 1)[:, None], STILL)


def running(q: np.ndarray) -> np.ndarray:
    """Products of the first k rows, for every k: by doubling, a few vector operations for a batch."""
    q, d = q.copy(), 1
    while d < len(q):
        q[d:] = product(q[:-d], q[d:])
        d *= 2
    return q


def orientations(samples: DataFrame, by: str, key: str, most_gap_s: float = MOST_GAP_S) -> DataFrame:
    """(by, key, t, qx, qy, qz, qw) of samples (by, key, t in ns, rx, ry, rz in radians a second).

    A session starts at (0, 0, 0, 1); samples of one time follow by key; one without a time or a session has no
    orientation and is left out.
    """
    spark = samples.sparkSession
    ship_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rate = [F.col(c).cast("double").alias(c) for c in ("rx", "ry", "rz")]
    order = [by, "t", key]
    dealt = samples.where(F.col(by).isNotNull() & F.col("t").isNotNull()).select(by, key, F.col("t").cast("long").alias("t"), *rate).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kinds = {f.name: f.dataType for f in dealt.schema}
    four = [T.StructField(c, T.DoubleType()) for c in PARTS]
    out = T.StructType([T.StructField(by, kinds[by]), T.StructField(key, kinds[key]), T.StructField("t", T.LongType()), T.StructField("part", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("rx", "ry", "rz")), *four])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, session, last, carry = TaskContext.get().partitionId(), None, 0, STILL
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.column(0).to_pylist()
            t = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            rates = np.column_stack([batch.column(3 + k).to_numpy(zero_copy_only=False) for k in range(3)]).astype(float)
            starts = [k for k in range(n) if k == 0 or names[k] != names[k - 1]]
            q = np.empty((n, 4))
            for a, b in zip(starts, [*starts[1:], n], strict=True):
                fresh = names[a] != session
                before = np.concatenate([[t[a] if fresh else last], t[a : b - 1]])
                own = running(steps(t[a:b], before, rates[a:b], most_gap_s))
                q[a:b] = own if fresh else product(np.broadcast_to(carry, own.shape), own)
                session, last, carry = names[b - 1], t[b - 1], q[b - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([part] * n, pa.int32()), *batch.columns[3:], *(pa.array(q[:, k]) for k in range(4))], names=[f.name for f in out])

    local = cut(dealt.mapInArrow(pieces, out))
    ends = local.groupBy(by, "part").agg(F.min_by(F.struct("t", "rx", "ry", "rz"), F.struct("t", key)).alias("a"), F.max_by(F.struct("t", *PARTS), F.struct("t", key)).alias("z"))
    flat = ends.select(by, "part", F.col("a.t").alias("t0"), "a.rx", "a.ry", "a.rz", F.col("z.t").alias("t1"), *(F.col(f"z.{c}").alias(c) for c in PARTS)).repartition(parts, by).sortWithinPartitions(by, "part")
    carried = T.StructType([T.StructField(by, kinds[by]), T.StructField("part", T.IntegerType()), *(T.StructField(f"c{c}", T.DoubleType()) for c in PARTS)])

    def before_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, last, carry = None, 0, STILL
        for batch in batches:
            rows, found = batch.to_pylist(), []
            for r in rows:
                if r[by] != session:
                    session, carry = r[by], STILL
                else:
                    rates = np.array([[np.nan if r[c] is None else r[c] for c in ("rx", "ry", "rz")]], float)
                    step = steps(np.array([r["t0"]]), np.array([last]), rates, most_gap_s)
                    carry = product(carry[None], step)[0]
                found.append(carry)
                last, carry = r["t1"], product(carry[None], np.array([[r[c] for c in PARTS]]))[0]
            q = np.array(found).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(q[:, k]) for k in range(4))], names=[f.name for f in carried])

    both = local.join(flat.mapInArrow(before_pieces, carried), [by, "part"])
    return both.select(by, key, "t", *_unit_product([f"c{c}" for c in PARTS], list(PARTS)))


def _unit_product(a: list[str], b: list[str]) -> list[Column]:
    (ax, ay, az, aw), (bx, by, bz, bw) = ([F.col(c) for c in q] for q in (a, b))
    q = [aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz]
    size = F.sqrt(sum((v * v for v in q[1:]), q[0] * q[0]))
    return [(v / size).alias(n) for v, n in zip(q, PARTS, strict=True)]
