"""Nested survey documents: projections, run-length masks and GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.levels import fix_quality, worst_quality
from kerbside.functions.stats import counted, interpolated, nearest_rank, rounded

VOTE = "struct<frameIndex: int, sampleCount: bigint, h95M: double>"
CELL = f"struct<localGroundM: double, h95M: double, extent95M: double, status: string, evidenceFrameIndices: array<int>, frameVotes: array<{VOTE}>>"
#: An assessment's measurements, wrapped or not.
ASSESSMENT = f"assessment struct<measurements: array<{CELL}>>, measurements array<{CELL}>"


def cells_of(documents: DataFrame, keys: list[str], json: str) -> DataFrame:
    """A row for each cell of each document; text that is no document gives none."""
    doc = F.from_json(json, ASSESSMENT)
    found = documents.select(*keys, F.coalesce(doc["assessment"]["measurements"], doc["measurements"]).alias("_m"))
    return found.select(*keys, F.posexplode("_m").alias("cell", "c")).select(*keys, "cell", "c.*")


def stretch_projection(cells: DataFrame, keys: list[str]) -> DataFrame:
    """p95 (nearest rank) and the greatest extent of measured cells."""
    measured = cells.where((F.col("status") == "measured") & F.col("extent95M").isNotNull())
    return measured.groupBy(*keys).agg(nearest_rank("extent95M", 0.95).alias("p95"), F.max("extent95M").alias("tallest"), F.count("*").alias("cells"))


def frame_readings(cells: DataFrame, keys: list[str]) -> DataFrame:
    """What each frame (numbered from 1) says: cells, samples, heights over ground, disagreement, evidence."""
    vote = lambda v: F.struct((v["frameIndex"] + 1).alias("frame"), F.lit(True).alias("vote"), v["sampleCount"].alias("n"), (v["h95M"] - F.col("localGroundM")).alias("over"), F.abs(v["h95M"] - F.col("h95M")).alias("off"))
    shown = lambda f: F.struct((f + 1).alias("frame"), F.lit(False).alias("vote"), F.lit(None).cast("bigint").alias("n"), *(F.lit(None).cast("double").alias(c) for c in ("over", "off")))
    none = F.array().cast("array<struct<frame: int, vote: boolean, n: bigint, over: double, off: double>>")
    # Both kinds of lines come from one reading of the cells.
    each = F.concat(F.coalesce(F.transform("frameVotes", vote), none), F.coalesce(F.transform("evidenceFrameIndices", shown), none))
    g = cells.select(*keys, F.explode(each).alias("_l")).select(*keys, "_l.*").groupBy(*keys, "frame")
    return g.agg(counted(F.col("vote")).alias("cells"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("samples"), interpolated("over").alias("median_height"), F.max("over").alias("max_height"), F.max("off").alias("disagreement"), counted(~F.col("vote")).alias("evidence"))


def rle_encode(bits: DataFrame, key: str, at: str) -> DataFrame:
    """Runs (start, count) of the positions that are set."""
    o = Window.partitionBy(key).orderBy(at)
    island = bits.select(key, at).distinct().withColumn("_g", F.col(at) - F.row_number().over(o))
    return island.groupBy(key, "_g").agg(F.min(at).alias("start"), F.count("*").alias("count")).drop("_g")


def rle_decode(runs: DataFrame, key: str, at: str) -> DataFrame:
    return runs.where("count > 0").select(key, F.explode(F.sequence("start", F.col("start") + F.col("count") - 1)).alias(at))


def track(positions: DataFrame, key: str, order: str) -> DataFrame:
    """Centre, path without successive repeats, and its GeoJSON line where it has two points; and the worst quality
    of its places where an accuracy (metres) is there."""
    o = Window.partitionBy(key).orderBy(order)
    new = F.lag(F.struct("lat", "lon")).over(o)
    kept = positions.withColumn("_k", ~F.coalesce(new == F.struct("lat", "lon"), F.lit(False)))
    worst = [worst_quality(fix_quality(F.col("accuracy"))).alias("quality")] if "accuracy" in positions.columns else []
    g = kept.groupBy(key).agg(*worst, F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.sort_array(F.collect_list(F.when(F.col("_k"), F.struct(F.col(order).alias("o"), F.col("lon").alias("x"), F.col("lat").alias("y"))))).alias("_p"))
    path = F.transform("_p", lambda p: F.array(p["x"], p["y"]))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), path.alias("coordinates")), {"ignoreNullFields": "false"})
    return g.select(key, "lat", "lon", F.size("_p").cast("long").alias("vertices"), F.when(F.size("_p") >= 2, line).alias("line"), *(["quality"] if worst else []))


def reading_features(tracks: DataFrame, key: list[str], line: str, band: str, properties: list[str]) -> DataFrame:
    """A row for each GeoJSON feature: the line and the band of each reading that has a line.

    Properties without a value stay, as null. Written as text, a row a line, this is a file of features
    that needs no task to hold all of them.
    """
    parts = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(g).alias("g")) for k, g in (("track", line), ("band", band))))
    f = tracks.where(F.col(line).isNotNull()).select(*key, *(p for p in properties if p not in key), F.explode(parts).alias("_f"))
    told = F.to_json(F.struct(*properties, F.col("_f.kind").alias("kind"), F.lit("not-ready").alias("operationalStatus")), {"ignoreNullFields": "false"})
    text = F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce("_f.g", F.lit("null")), F.lit(',"properties":'), told, F.lit("}"))
    return f.select(*key, F.col("_f.kind").alias("kind"), text.alias("feature"))


def session_export(observations: DataFrame, runs: DataFrame, key: str, run: str, item: str, value: str) -> DataFrame:
    """A JSON document for each clip (runs: key, run): its runs, and the trials of each object in each run.

    Runs without observations are left out. A clip's runs are some few sittings' worth, so they fit a row.
    """
    scoped = observations.join(runs.select(key, run).distinct(), run)
    n, mean, sd = F.count(value), F.avg(value), F.stddev_samp(value)
    rows = scoped.groupBy(key, run, item).agg(n.alias("n"), F.round(mean, 6).alias("mean"), F.round(sd, 6).alias("sd"))
    listed = F.sort_array(F.collect_list(F.struct(run, item, "n", "mean", "sd")))
    g = rows.where("n > 0").groupBy(key).agg(F.sort_array(F.collect_set(run)).alias("runIds"), listed.alias("repeatability"))
    return g.select(key, F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.col(key).alias("clipKey"), "runIds", "repeatability"), {"ignoreNullFields": "false"}).alias("document"))


def frame_number(name: Column) -> Column:
    """The digits of a frame's file name."""
    return F.nullif(F.regexp_replace(name, "[^0-9]", ""), F.lit("")).cast("int")


def with_positions(frames: DataFrame, packets: DataFrame, name: str, order: str) -> DataFrame:
    """Frames with the position of their number; of several packets the later one counts."""
    fields = [c for c in packets.columns if c not in ("canonical", order)]
    last = packets.groupBy("canonical").agg(F.max_by(F.struct(*fields), order).alias("_p"))
    return frames.withColumn("canonical", frame_number(F.col(name))).join(last, "canonical", "left").select(*frames.columns, "canonical", "_p.*")


def band_polygon(path: DataFrame, key: str, order: str, half_m: float) -> DataFrame:
    """A closed GeoJSON ring around a path (lat, lon): its left side forward, its right side back."""
    o = Window.partitionBy(key).orderBy(order)
    first = lambda f, c: F.coalesce(f(c).over(o), F.col(c))
    flat = F.cos(F.radians("lat")) * 111320.0
    dx, dy = (first(F.lead, "lon") - first(F.lag, "lon")) * flat, (first(F.lead, "lat") - first(F.lag, "lat")) * 111320.0
    sides = path.withColumns({"_x": dx, "_y": dy, "_f": flat}).withColumn("_l", F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))).where("_l > 0")
    east, north = -F.col("_y") / F.col("_l") * half_m / F.col("_f"), F.col("_x") / F.col("_l") * half_m / 111320.0
    at = lambda s: F.array(rounded(F.col("lon") + s * east, 9), rounded(F.col("lat") + s * north, 9))
    g = sides.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), at(1).alias("l"), at(-1).alias("r")))).alias("v"))
    left, right = F.transform("v", lambda p: p["l"]), F.reverse(F.transform("v", lambda p: p["r"]))
    ring = F.concat(left, right, F.slice(left, 1, 1))
    return g.where(F.size("v") >= 2).select(key, F.size(ring).cast("long").alias("corners"), F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))).alias("geometry"))


def scoped_trials(trials: DataFrame, runs: DataFrame, objects: DataFrame) -> DataFrame:
    """Repeat statistics of each defined object in each run of a clip that measured it; trials of other runs, and
    of objects that are not defined, are out of scope. Objects are few and are sent to the trials."""
    inside = trials.join(runs.select("run_id").distinct(), "run_id", "left_semi").join(F.broadcast(objects.select("object_id", "code").distinct()), "object_id")
    return inside.groupBy("object_id", "code", "run_id").agg(F.count("*").alias("n"), F.avg("height").alias("mean"), (F.max("height") - F.min("height")).alias("spread"))
