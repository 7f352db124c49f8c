"""Files that surveys come in, made from the test tables and read back, as named queries with their DuckDB SQL."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside import shim
from kerbside.functions import vectors
from kerbside.operators import changes
from kerbside.plans.catalog import query
from kerbside.plans.streams import folder
from kerbside.plans.surveys import PIXELS, pixels
from kerbside.session import ship_package
from kerbside.sources import geojson, glb, npz

#: Roads in a file that is written.
ROADS_IN_FILE = 64
#: A row-major turn about z, a move, and a scale in the last row.
ALIGNED = [[0.0, -2.0, 0.0, 1.0], [2.0, 0.0, 0.0, -3.0], [0.0, 0.0, 2.0, 0.5], [0.0, 0.0, 0.0, 2.0]]


@query(", n AS (SELECT marker, km, mlat, mlon FROM markers WHERE km % 6 <> 5) SELECT CASE WHEN km % 4 = 0 THEN 'default' ELSE 'R' || km % 4 END AS road, km::DOUBLE AS km, round(mlat, 9) AS mlat, round(mlon, 9) AS mlon FROM n")
def geojson_markers(s, d):
    """A file for each marker; every sixth has one coordinate only and is no place."""
    m = shim.markers(s, d)
    at = F.when(F.col("km") % 6 == 5, F.array("mlon")).otherwise(F.array("mlon", "mlat"))
    road = F.when(F.col("km") % 4 != 0, F.concat(F.lit("R"), (F.col("km") % 4).cast("string")))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), at.alias("coordinates")).alias("geometry"), F.struct(road.alias("road"), F.col("km").cast("double").alias("km")).alias("properties"))
    path = folder(s, "markers")
    whole = m.groupBy(F.col("km") % 5).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value")).select("value")
    whole.repartition(5, "value").write.option("maxRecordsPerFile", 1).text(path)
    read = geojson.read_markers(s, path, "default")
    return read.withColumns({c: F.round(c, 9) for c in ("mlat", "mlon")})


@query(", f AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) - 1 AS ord, lat, lon, count(*) OVER (PARTITION BY session_id) AS n FROM fixes) SELECT 'road ' || session_id AS road, CAST(ord AS INT) AS ord, round(lat, 9) AS lat, round(lon, 9) AS lon FROM f WHERE n >= 2")
def geojson_roads(s, d):
    """Tracks of ROADS_IN_FILE sessions or so to a file, so there are no more files than that many roads ask for."""
    o = F.struct("t", "event_id", F.array("lon", "lat").alias("c"))
    lines = shim.fixes(s, d).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(o)), lambda x: x["c"]).alias("c"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.col("c").alias("coordinates")).alias("geometry"), F.struct(F.concat(F.lit("road "), F.col("session_id").cast("string")).alias("road")).alias("properties"))
    path = folder(s, "roads")
    files = max(1, shim.fixes(s, d).select("session_id").distinct().count() // ROADS_IN_FILE)
    whole = lines.groupBy(F.pmod(F.xxhash64("session_id"), F.lit(files))).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    whole.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return geojson.read_roads(s, path).withColumns({c: F.round(c, 9) for c in ("lat", "lon")})


def packed_clouds(s, d) -> DataFrame:
    """GLB files of every 64th point: path, content. Colours are taken from the points' numbers; some files have none."""
    ship_package(s)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("point_id")
        k = int(g["g"].iloc[0])
        shade = None if k % 3 == 0 else np.column_stack([g["point_id"] % 256, g["point_id"] // 7 % 256, np.full(len(g), k)])
        return pd.DataFrame({"path": [f"cloud{k}.glb"], "content": [glb.pack(g[["x", "y", "z"]].to_numpy(), shade, ALIGNED if k % 2 else None)]})

    return shim.points(s, d).withColumn("g", F.col("point_id") % 64).groupBy("g").applyInPandas(one, "path string, content binary")


@query(
    ", p AS (SELECT point_id, point_id % 64 AS g, row_number() OVER (PARTITION BY point_id % 64 ORDER BY point_id) - 1 AS i, x, y, z FROM points) SELECT 'cloud' || g || '.glb' AS path, i, CASE WHEN g % 3 <> 0 THEN (point_id % 256)::INT END AS red, CASE WHEN g % 3 <> 0 THEN (point_id // 7 % 256)::INT END AS green, CASE WHEN g % 3 <> 0 THEN g::INT END AS blue,"
    " round(CASE WHEN g % 2 = 1 THEN (-2 * y + 1) / 2 ELSE x END, 6) AS x, round(CASE WHEN g % 2 = 1 THEN (2 * x - 3) / 2 ELSE y END, 6) AS y, round(CASE WHEN g % 2 = 1 THEN (2 * z + 0.5) / 2 ELSE z END, 6) AS z FROM p"
)
def glb_points(s, d):
    """Points in the frame that the file's alignment leads to."""
    at = glb.parse(packed_clouds(s, d))
    place = vectors.vector(*(F.col(c) for c in vectors.AXES))
    moved = at.withColumn("_p", F.when(F.col("alignment").isNotNull(), vectors.transformed(F.col("alignment"), place)).otherwise(place))
    return moved.select("path", "i", "red", "green", "blue", *(F.round(F.col("_p")[c], 6).alias(c) for c in vectors.AXES))


@query(PIXELS + ", f AS (SELECT frame, 40 AS height, 40 AS width, sum(coalesce(depth, 0)) AS depth, sum(conf) AS confidence, count(*) AS n FROM pixels GROUP BY 1) SELECT 'run' || frame % 2 || '.npz' AS path, CAST(frame // 2 AS INT) AS frame, height, width, round(depth, 2) AS depth, round(confidence, 2) AS confidence, n FROM f")
def depth_runs(s, d):
    """Two archives of three frames each, of 40 by 40 pixels; a pixel that is not there is 0."""
    ship_package(s)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        k = int(g["frame"].iloc[0]) % 2
        found = sorted(g["frame"].unique())
        depth, confidence = (np.zeros((len(found), 40, 40), "<f4") for _ in range(2))
        at = np.searchsorted(found, g["frame"]), g["r"], g["c"]
        depth[at], confidence[at] = g["depth"].fillna(0), g["conf"]
        out = io.BytesIO()
        np.savez(out, depth=depth, confidence=confidence, intrinsics=np.zeros((len(found), 3, 3), "<f4"), extrinsics=np.zeros((len(found), 3, 4), "<f4"))
        return pd.DataFrame({"path": [f"run{k}.npz"], "content": [out.getvalue()]})

    files = pixels(s, d).select("frame", "r", "c", "depth", "conf").groupBy(F.col("frame") % 2).applyInPandas(one, "path string, content binary")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 2).alias(c)
    there = F.size(F.filter("confidence", lambda v: v > 0)).cast("long").alias("n")
    return npz.parse(files).select("path", "frame", "height", "width", total("depth"), total("confidence"), there)


@query(", o AS (SELECT order_id, team_id, status FROM worders WHERE order_id % 3 <> 0), n AS (SELECT order_id, team_id, CASE WHEN order_id % 5 = 0 THEN 'other' ELSE status END AS status FROM worders WHERE order_id % 2 = 0) SELECT *, false AS conflict FROM o UNION ALL SELECT n.*, false FROM n ANTI JOIN o USING (order_id) UNION ALL SELECT n.*, true FROM n JOIN o USING (order_id) WHERE n.status <> o.status OR n.team_id <> o.team_id")
def orders_put_if_absent(s, d):
    """What is there after new orders came, and those that came under a key with other content."""
    o = shim.orders(s, d).select("order_id", "team_id", "status")
    new = o.where("order_id % 2 = 0").withColumn("status", F.when(F.col("order_id") % 5 == 0, "other").otherwise(F.col("status")))
    merged, conflict = changes.insert_if_absent(o.where("order_id % 3 != 0"), new, ["order_id"], ["team_id", "status"])
    return merged.withColumn("conflict", F.lit(False)).unionByName(conflict.withColumn("conflict", F.lit(True)))


CAMERA = [[0.6, 0.0, 0.8], [0.0, 1.0, 0.0], [-0.8, 0.0, 0.6]]


@query("SELECT point_id, round(-(0.6 * x - 0.8 * z), 6) AS cx, round(-y, 6) AS cy, round(-(0.8 * x + 0.6 * z), 6) AS cz, round((2 * x - 3) * w - 1 * (w - 1), 6) AS sx, round((-2 * y + 1) * w + 2 * 0 * (w - 1), 6) AS sy FROM points")
def camera_transforms(s, d):
    """The centre of a camera whose move is the point; and the point turned, moved, then scaled about (1, 0, 0)."""
    p = shim.points(s, d)
    at = vectors.vector(*(F.col(c) for c in vectors.AXES))
    e = F.array(*(x for row, t in zip(CAMERA, vectors.AXES, strict=True) for x in (*map(F.lit, row), F.col(t))))
    turn = F.array(*(F.lit(v) for r in ([2.0, 0.0, 0.0, -3.0], [0.0, -2.0, 0.0, 1.0], [0.0, 0.0, 2.0, 0.5], [0.0, 0.0, 0.0, 1.0]) for v in r))
    both = vectors.matrix_product(vectors.scaled_about(vectors.vector(F.lit(1), F.lit(0), F.lit(0)), F.col("w")), turn)
    moved = p.select("point_id", vectors.camera_centre(e).alias("c"), vectors.transformed(both, at).alias("m"))
    return moved.select("point_id", *(F.round(F.col("c")[a], 6).alias(f"c{a}") for a in vectors.AXES), F.round("m.x", 6).alias("sx"), F.round("m.y", 6).alias("sy"))
