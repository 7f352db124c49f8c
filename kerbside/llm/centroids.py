"""Centroid clustering with Drake's adaptive bounds: Lloyd's rounds, exact, without most distances.

Each vector carries its cluster, an upper bound of the distance to its centroid, lower bounds for the
several next nearest centroids, and one remainder bound below all others. When centroids move, bounds give
way by what they moved. A vector whose upper bound stays below all its lower bounds keeps its cluster unread;
else its own distance is worked out, then those of the centroids whose bounds do not lie above it, and only
where the remainder bound does not either, all of them. Bounds are floats widened by more than their
rounding; a cluster changes only by exact integer distances, and ties go to the smaller number. How many
bounds a vector carries adapts: from a quarter of the centroids down to what a round has needed, an eighth
at least.

Vectors are dealt as their files are. A round is one pass that writes the state as a staged table, so a
lost executor costs the tasks it held; centroids (k rows) go out with the tasks, and sums come back as k
times `dims` numbers, of the vectors that changed cluster alone after the first round.

Defined results: rows whose vector is null, has another length, or has a null or non-finite component are
left out; components are saturated at 2^27 after scaling (half a million before), so that sums of squares fit
a long; a null key counts as an empty one in the choice of first centroids; repeated rows are clustered
each, and may start as equal centroids, of which the larger number stays empty and where it was; fewer rows
than k make fewer centroids; an empty table gives an empty result; a sum of distances beyond a long is null.
Other columns are dropped, unless named to be kept; names of the new ones then raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import map_arrow, stage

SCALE, MOST = 256, 1 << 27
#: Bounds are widened by this share, far above the rounding of the few operations on them.
SLACK = 1e-12
#: Below this size the products of two vectors are exact in floats.
FLOAT_EXACT = 1 << 22
NEW = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


class Bounds(NamedTuple):
    """Of n vectors: cluster and its upper bound, b further centroids and their lower bounds, the remainder's,
    the cluster before, how many bounds could not be told apart, and how many distances were worked out."""

    cluster: np.ndarray
    upper: np.ndarray
    ids: np.ndarray
    lows: np.ndarray
    rest: np.ndarray
    before: np.ndarray
    used: np.ndarray
    worked: np.ndarray


def all_squares(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of each vector to each centroid, exact."""
    if not len(q) or not len(centres) or max(np.abs(q).max(), np.abs(centres).max()) <= FLOAT_EXACT // int(q.shape[1] ** 0.5 + 1):
        a, b = q.astype(float), centres.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((q - c) ** 2).sum(1) for c in centres], axis=1)


def some_squares(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of vector i to centroid i, exact."""
    return ((q - centres) ** 2).sum(1)


def below(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float)) * (1 - SLACK)


def above(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float)) * (1 + SLACK)


def scan(q: np.ndarray, centres: np.ndarray, b: int) -> Bounds:
    """Bounds from all distances."""
    n, k = len(q), len(centres)
    squares = all_squares(q, centres)
    order = np.argsort(squares, axis=1, kind="stable")  # equal distances: smaller number first
    near = np.take_along_axis(squares, order[:, : b + 2], axis=1)
    rest = below(near[:, b + 1]) if k > b + 1 else np.full(n, np.inf)
    full = np.full(n, k)
    return Bounds(order[:, 0].copy(), above(near[:, 0]), order[:, 1 : b + 1].copy(), below(near[:, 1 : b + 1]), rest, np.full(n, -1), full, full)


def most_outside(own: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """How far the centroid that moved most has moved, of those that are not a row's own."""
    far = np.argsort(-moved)[: own.shape[1] + 1]
    held = (own[:, :, None] == far).any(axis=1)
    first = held.argmin(axis=1)
    return np.where(held[np.arange(len(own)), first], 0.0, moved[far[first]])


def follow(q: np.ndarray, s: Bounds, centres: np.ndarray, moved: np.ndarray, b: int) -> Bounds:
    """Bounds after the centroids moved to `centres`, each by at most moved; at most b of them are kept."""
    cluster, ids = s.cluster.copy(), s.ids.copy()
    most = most_outside(np.column_stack([cluster, ids]), moved)
    upper = (s.upper + moved[cluster]) * (1 + SLACK)
    lows = s.lows - moved[ids] - SLACK * (np.abs(s.lows) + moved[ids])
    rest = np.where(np.isinf(s.rest), np.inf, s.rest - most - SLACK * (np.abs(s.rest) + most))
    used, worked = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    floor = np.minimum(lows.min(axis=1), rest) if lows.shape[1] else rest
    open_ = np.flatnonzero(upper >= floor)
    own = some_squares(q[open_], centres[cluster[open_]])
    upper[open_] = above(own)
    worked[open_] = 1
    left = upper[open_] >= floor[open_]
    open_, own = open_[left], own[left]
    whole = rest[open_] <= upper[open_]
    rows, own = open_[~whole], own[~whole]
    if len(rows):
        near = lows[rows] <= upper[rows, None]
        i, j = np.nonzero(near)
        squares = np.full((len(rows), 1 + ids.shape[1]), np.iinfo(np.int64).max)
        squares[:, 0] = own
        squares[i, j + 1] = some_squares(q[rows[i]], centres[ids[rows[i], j]])
        names = np.column_stack([cluster[rows], ids[rows]])
        least = squares.min(axis=1, keepdims=True)
        win = np.where(squares == least, names, len(centres)).argmin(axis=1)
        bounds = np.column_stack([below(own), lows[rows]])
        bounds[i, j + 1] = below(squares[i, j + 1])
        at = np.arange(len(rows))
        upper[rows], cluster[rows] = above(least[:, 0]), names[at, win]
        names[at, win], bounds[at, win] = names[:, 0], bounds[:, 0]  # the old centroid takes the winner's place
        ids[rows], lows[rows] = names[:, 1:], bounds[:, 1:]
        used[rows] = near.sum(axis=1)
        worked[rows] += used[rows]
    order = np.argsort(lows, axis=1, kind="stable")
    ids, lows = np.take_along_axis(ids, order, axis=1), np.take_along_axis(lows, order, axis=1)
    if b < lows.shape[1]:
        rest = np.minimum(rest, lows[:, b])
        ids, lows = ids[:, :b], lows[:, :b]
    rows = open_[whole]
    if len(rows):
        again = scan(q[rows], centres, b)
        cluster[rows], upper[rows], ids[rows], lows[rows], rest[rows] = again[:5]
        used[rows] = worked[rows] = len(centres)
    return Bounds(cluster, upper, ids, lows, rest, s.cluster, used, worked)


def arrays_of(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a column of lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.reshape(-1), kind))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def assign(df: DataFrame, keep: list[T.StructField], centres: np.ndarray, moved: np.ndarray | None, b: int) -> DataFrame:
    """One assignment: from vectors alone where moved is None, else from the state of the round before."""
    names = [f.name for f in keep]
    state = "_v array<int>, _cluster int, _upper double, _ids array<int>, _lows array<double>, _rest double, _before int, _used int, _worked int"
    schema = T.StructType([*keep, *T.StructType.fromDDL(state)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            q = matrix(batch.column("_v"), n).astype(np.int64)
            if moved is None:
                s = scan(q, centres, b)
            else:
                one = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
                old = Bounds(one("_cluster").astype(np.int64), one("_upper"), matrix(batch.column("_ids"), n).astype(np.int64), matrix(batch.column("_lows"), n), one("_rest"), *[np.zeros(0)] * 3)
                s = follow(q, old, centres, moved, b)
            found = {"_v": batch.column("_v"), "_cluster": pa.array(s.cluster, pa.int32()), "_upper": pa.array(s.upper), "_ids": arrays_of(s.ids, pa.int32()), "_lows": arrays_of(s.lows, pa.float64()), "_rest": pa.array(s.rest)}
            found |= {f"_{c}": pa.array(getattr(s, c), pa.int32()) for c in ("before", "used", "worked")}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found.values()], names=[*names, *found])

    return map_arrow(df, run, schema)


def moved_sums(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """By cluster, what its vectors' sum and count change by; tasks add up their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            q = matrix(batch.column(0), batch.num_rows).astype(np.int64)
            for sign, c in ((1, batch.column(1)), (-1, batch.column(2))):
                c = c.to_numpy()
                there = c >= 0
                if there.any():
                    np.add.at(sums, c[there], sign * q[there])
                    np.add.at(counts, c[there], sign)
        some = np.flatnonzero(np.any(sums != 0, axis=1) | (counts != 0))
        table = np.column_stack([counts, sums])[some]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dims + 1), pa.int32()), pa.array(np.tile(np.arange(dims + 1), len(some)), pa.int32()), pa.array(table.reshape(-1), pa.int64())], names=["c", "d", "v"])

    changed = state.where("_cluster <> _before").select("_v", "_cluster", "_before")
    table = np.zeros((k, dims + 1), np.int64)
    for r in map_arrow(changed, run, "c int, d int, v long").groupBy("c", "d").agg(F.sum("v").alias("v")).collect():  # k * (dims + 1) rows
        table[r.c, r.d] = r.v
    return table[:, 1:], table[:, 0]


def whole_vectors(df: DataFrame, vector: str, dims: int, keep: list[str]) -> DataFrame:
    """The kept columns and the integer vectors of the rows that have one."""
    x = F.col(vector)
    good = x.isNotNull() & (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    least, most = F.lit(float(-MOST)), F.lit(float(MOST))
    whole = F.transform(x, lambda v: F.floor(F.greatest(least, F.least(most, v.cast("double") * SCALE))).cast("int"))
    return df.where(F.coalesce(good, F.lit(False))).select(*(F.col(c).alias(f"_{n}") for n, c in enumerate(keep)), whole.alias("_v"))


class Model(NamedTuple):
    centres: np.ndarray
    #: A round: bounds carried, vectors that changed cluster, distances worked out.
    rounds: list[tuple[int, int, int]]


def cluster(df: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 40, rounds: int = 5, dims: int = 64, seed: str = "2:", keep: list[str] | None = None) -> tuple[DataFrame, Model]:
    """The kept columns (the key by default), and cluster, distance, cluster_inertia, inertia, centroid_sha256.

    First centroids are the k vectors with the smallest SHA-256 of the seed and the key.
    """
    keep = [key] if keep is None else keep
    if clash := set(NEW) & {c.lower() for c in keep}:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    vectors = stage(whole_vectors(df, vector, dims, [key, *keep]), "vectors")
    first = vectors.withColumn("_hash", F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("_0").cast("string"), F.lit(""))), 256)).orderBy("_hash", "_v").limit(k).collect()
    centres = np.array([r["_v"] for r in first], np.int64).reshape(-1, dims)
    kept = [T.StructField(f"_{n + 1}", df.schema[c].dataType) for n, c in enumerate(keep)]
    names = [f.name for f in kept]
    k, log = len(centres), []
    if not k:
        nothing = T.StructType([*(df.schema[c] for c in keep), *T.StructType.fromDDL("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")])
        return df.sparkSession.createDataFrame([], nothing), Model(centres, log)
    b = min(-(-k // 4), k - 1)
    state, moved = vectors.select(*names, "_v"), None
    sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for _ in range(rounds):
        state = stage(assign(state, kept, centres, moved, b), "clusters")
        more, fewer = moved_sums(state, k, dims)
        sums, counts = sums + more, counts + fewer
        told = state.agg(F.max("_used").alias("used"), F.sum(F.col("_worked").cast("long")).alias("worked"), F.count_if(F.col("_cluster") != F.col("_before")).alias("changed")).first()
        log.append((b, told.changed, told.worked))
        new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centres)  # // is the floor
        moved, centres = above(some_squares(new, centres)), new
        b = min(b, max(-(-k // 8), told.used)) if len(log) > 1 else b
    state = assign(state, kept, centres, moved, b)
    square = F.aggregate(F.zip_with("_v", "_c", lambda x, y: (x.cast("long") - y) * (x.cast("long") - y)), F.lit(0).cast("long"), lambda a, v: a + v)
    rows = [(c, [int(x) for x in v], sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(centres)]
    table = df.sparkSession.createDataFrame(rows, "_cluster int, _c array<long>, centroid_sha256 string")
    last = stage(state.join(F.broadcast(table), "_cluster").select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), F.col("_cluster").alias("cluster"), square.alias("distance"), "centroid_sha256"), "clustered")
    inertia = last.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    inertia = inertia.crossJoin(inertia.agg(F.try_sum("cluster_inertia").alias("inertia")))  # k rows and one
    return last.join(F.broadcast(inertia), "cluster").select(*keep, *NEW), Model(centres, log)
