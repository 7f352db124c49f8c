"""Roads from camera tracks, and places between the road's frame and the world.

Vertices, points, cells and rungs are rows; a track is thinned as a stream of its places in order, and a place
meets only the pieces of its road about it.
Grounds come as one plane for each road: (road, nx, ny, nz, offset), the normal of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from kerbside.functions.vectors import AXES, cross, dot, let, unit, vector
from kerbside.session import ship_package

#: Metres between the vertices kept, and the least way that still gives a direction.
SPACING_M, LEAST_WAY_M = 0.5, 1e-6
#: Pieces of a road's mean length in one cell along it.
PIECES_IN_CELL = 8


def xyz(prefix: str = "") -> Column:
    return vector(*(F.col(f"{prefix}{c}") for c in AXES))


def moved(a: Column, direction: Column, by: Column) -> Column:
    """a + direction * by."""
    return vector(*(a[c] + direction[c] * by for c in AXES))


def difference(a: Column, b: Column) -> Column:
    return vector(*(a[c] - b[c] for c in AXES))


def long(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def uprights(grounds: DataFrame) -> DataFrame:
    """road, its unit normal _n and offset _d; a road whose normal has no direction is left out."""
    n = vector(*(F.col(f"n{c}") for c in AXES))
    g = grounds.select("road", unit(n).alias("_n"), (F.col("offset") / F.when(long(n) > 0, long(n))).alias("_d"))
    return g.where(F.col("_n").isNotNull())


def on_ground(p: Column) -> Column:
    """The foot of a place on the plane (_n, _d)."""
    return moved(p, F.col("_n"), -(dot(F.col("_n"), p) + F.col("_d")))


def finite_poses(poses: DataFrame) -> DataFrame:
    """Poses with their place _p, null for those that are not finite."""
    finite = sum((F.col(c) * 0 for c in AXES), F.lit(0.0)) == 0  # neither null, NaN nor infinite
    return poses.withColumn("_p", F.when(finite, xyz()))


def kept_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of places (road, x, y, z) in their roads' order those SPACING_M or more from the last one kept, numbered;
    a road that keeps one place only also keeps its last, if they differ. Holds one place of one road."""
    road = kept = end = kind = None
    n = 0

    def apart(a: tuple, b: tuple) -> float:
        return math.sqrt(sum((u - v) * (u - v) for u, v in zip(a, b, strict=True)))

    def closed() -> list[tuple]:
        return [(road, 1, *end)] if n == 1 and not apart(end, kept) <= LEAST_WAY_M else []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        types = (kind, pa.int64(), *(pa.float64(),) * 3)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["road", "ord", *AXES])

    for b in batches:
        rows, kind = [], b.schema.field(0).type
        for r, *at in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if n == 0 or r != road:
                rows += closed()
                road, n = r, 0
            if n == 0 or not apart(at, kept) < SPACING_M:
                rows.append((r, n, *at))
                kept, n = at, n + 1
            end = at
        yield batch(rows)
    if kind is not None:
        yield batch(closed())


def thinned_vertices(poses: DataFrame, grounds: DataFrame) -> DataFrame:
    """(road, ord, x, y, z): each track's places on the ground, those kept that lie SPACING_M or more from
    the last one kept. A track that stays within that keeps its first and its last place, if they differ.

    Which are kept goes from one to the next, so a track is read by one task, as a stream. Tracks are dealt by a
    hash of their road: by the road itself Spark would leave the dealing to the join before, whose rows it may read
    as they lie once it broadcasts the other side, a track's in many tasks.
    """
    ship_package(poses.sparkSession)
    there = finite_poses(poses).where("_p IS NOT NULL").join(uprights(grounds), "road")
    flat = there.select("road", "ord", "_p", on_ground(F.col("_p")).alias("_q")).repartition(F.xxhash64("road")).sortWithinPartitions("road", "ord", "_p")
    schema = StructType([StructField("road", poses.schema["road"].dataType), StructField("ord", LongType()), *(StructField(c, DoubleType()) for c in AXES)])
    return flat.select("road", *(F.col("_q")[c].alias(c) for c in AXES)).mapInArrow(kept_places, schema)


def thinned_tracks(poses: DataFrame, grounds: DataFrame) -> DataFrame:
    """(road, source_poses, vertices): how many poses each track has, and how many vertices thinned_vertices keeps.

    Poses are (road, ord, x, y, z); those that are not finite count as poses and are passed over.
    """
    kept = thinned_vertices(poses, grounds).groupBy("road").agg(F.count("*").alias("vertices"))
    told = poses.groupBy("road").agg(F.count("*").alias("source_poses")).join(uprights(grounds).select("road"), "road")
    return told.join(kept, "road", "left").withColumn("vertices", F.coalesce("vertices", F.lit(0)))


def edges(poses: DataFrame, grounds: DataFrame, offset_m: float) -> DataFrame:
    """(road, ord, x, y, z): the line beside each track, offset_m to the left of its way (to the right if below 0).

    A vertex is moved across the way from the vertex before it to the one after. A track without a way has no edge.
    """
    o = Window.partitionBy("road").orderBy("ord")
    line = thinned_vertices(poses, grounds).select("road", "ord", xyz().alias("p")).withColumn("_more", F.lead("ord").over(o))
    tracks = line.where("ord > 0 OR _more IS NOT NULL").drop("_more").join(uprights(grounds).select("road", "_n"), "road")
    way = unit(difference(F.coalesce(F.lead("p").over(o), F.col("p")), F.coalesce(F.lag("p").over(o), F.col("p"))))
    side = tracks.withColumn("_w", way).withColumn("_s", unit(cross(F.col("_n"), F.col("_w"))))
    out = side.withColumn("p", F.when(F.col("_s").isNotNull(), moved(F.col("p"), F.col("_s"), F.lit(float(offset_m)))).otherwise(F.col("p")))
    return out.select("road", "ord", *(F.col("p")[c].alias(c) for c in AXES))


def pieces(lines: DataFrame) -> DataFrame:
    """(road, ord, a, b, size, before, end, start): each road's pieces of some length, with the metres before them,
    at their end, and at the end of the piece before."""
    o = Window.partitionBy("road").orderBy("ord")
    both = lines.select("road", "ord", xyz().alias("a"), F.lead(xyz()).over(o).alias("b")).withColumn("size", long(difference(F.col("b"), F.col("a")))).where("size > 0")
    before = both.withColumn("before", F.sum("size").over(o) - F.col("size")).withColumn("end", F.col("before") + F.col("size"))
    return before.withColumn("start", F.coalesce(F.lag("end").over(o), F.lit(0.0)))


def to_world(places: DataFrame, lines: DataFrame, grounds: DataFrame, along: str = "along", distance: str = "distance", side: int = -1) -> DataFrame:
    """Places with x, y and z: so many metres along their road, and away from it to its right (left for side 1).

    What lies before the start or past the end is put at that end. A road without a way gives null. Pieces are
    dealt to the cells along their road that they reach into, cells of some mean lengths of its pieces, so a
    place meets only those of its cell; the last piece also has a cell of its own, for what is past the end.
    """
    every = pieces(lines)
    roads = every.groupBy("road").agg((F.sum("size") / F.count("*") * PIECES_IN_CELL).alias("_cell_m"), F.max("end").alias("_length"), F.max("ord").alias("_last"))
    at_cell = lambda s: F.floor(s / F.col("_cell_m"))
    reached = F.sequence(at_cell(F.col("start")), F.greatest(at_cell(F.col("start")), at_cell(F.col("end"))))
    dealt = every.join(roads, "road").withColumn("_cell", F.explode(F.when(F.col("ord") == F.col("_last"), F.concat(reached, F.array(F.lit(-1).cast("long")))).otherwise(reached)))
    line = dealt.groupBy("road", "_cell").agg(F.array_sort(F.collect_list(F.struct("ord", "a", "b", "size", "before", "end"))).alias("_line"))
    s = F.greatest(F.lit(0.0), F.col(along))
    at = places.join(roads.drop("_last"), "road", "left").withColumn("_cell", F.when(s > F.col("_length"), F.lit(-1).cast("long")).otherwise(at_cell(s)))
    at = at.join(line, ["road", "_cell"], "left").join(uprights(grounds), "road", "left")
    piece = F.when(F.size("_line") > 0, F.coalesce(F.try_element_at(F.filter("_line", lambda p: s <= p["end"]), F.lit(1)), F.try_element_at("_line", F.lit(-1))))

    def put(p: Column) -> Column:
        part = F.least(F.lit(1.0), (s - p["before"]) / p["size"])
        foot = vector(*(p["a"][c] + (p["b"][c] - p["a"][c]) * part for c in AXES))
        out = unit(cross(difference(p["b"], p["a"]), F.col("_n")))
        return moved(foot, out, -side * F.col(distance))

    found = at.withColumn("_w", let(piece, put))
    return found.select(*places.columns, *(F.col("_w")[c].alias(c) for c in AXES))


def cell_quads(cells: DataFrame, lines: DataFrame, grounds: DataFrame, size_m: float, side: int = -1) -> DataFrame:
    """Four corners (corner, x, y, z) for each cell (road, along_m, distance_m), near start, near end, far end, far start."""
    half = size_m / 2
    corner = F.explode(F.array(*(F.struct(F.lit(k).alias("corner"), (F.col("along_m") + i * half).alias("_along"), (F.col("distance_m") + j * half).alias("_away")) for k, (i, j) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1))))))
    each = cells.withColumn("_c", corner).select(*cells.columns, "_c.*")
    return to_world(each, lines, grounds, "_along", "_away", side).drop("_along", "_away")


def band_segments(lines: DataFrame, grounds: DataFrame, width_m: float, spacing_m: float = 1.0) -> DataFrame:
    """(road, kind, ord, ax .. bz): the rail along the road, the one width_m to its right, and rungs between them at
    the first vertices past each multiple of the spacing."""
    o = Window.partitionBy("road").orderBy("ord")
    v = lines.join(uprights(grounds).select("road", "_n"), "road").withColumn("a", xyz())
    v = v.withColumns({"_w": unit(difference(F.coalesce(F.lead("a").over(o), F.col("a")), F.coalesce(F.lag("a").over(o), F.col("a")))), "_step": F.coalesce(long(difference(F.col("a"), F.lag("a").over(o))), F.lit(0.0))})
    out = F.coalesce(unit(cross(F.col("_w"), F.col("_n"))), vector(*map(F.lit, (0, 0, 0))))
    v = v.withColumn("far", moved(F.col("a"), out, F.lit(float(width_m)))).withColumn("gone", F.sum("_step").over(o))
    v = v.withColumns({"b": F.lead("a").over(o), "far_b": F.lead("far").over(o)})
    # A rung may stand at each vertex once: the n-th stands where the way is n - 1 spacings at least. So rungs are
    # as many as multiples of the spacing so far, or one more than at the vertex before.
    multiple = F.floor(F.col("gone") / spacing_m)
    multiple = F.when((multiple + 1) * spacing_m <= F.col("gone"), multiple + 1).when(multiple * spacing_m > F.col("gone"), multiple - 1).otherwise(multiple)
    v = v.withColumn("_i", F.row_number().over(o)).withColumn("_rungs", F.col("_i") + F.least(F.lit(0), F.min(multiple + 1 - F.col("_i")).over(o)))
    rungs = v.withColumn("_before", F.coalesce(F.lag("_rungs").over(o), F.lit(0))).where("_rungs > _before")
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"))
    rails = v.where("b IS NOT NULL").select("road", "ord", F.explode(F.array(row("near", "a", "b"), row("far", "far", "far_b"))).alias("_r"))
    every = rails.unionByName(rungs.select("road", "ord", row("rung", "a", "far").alias("_r")))
    return every.where(F.lit(width_m > 0)).select("road", "_r.kind", "ord", *(F.col(f"_r.{e}.{c}").alias(f"{e}{c}") for e in "ab" for c in AXES))
