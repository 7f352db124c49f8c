"""Probes, labels, vectors, claims, exports and clouds as named queries, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside import shim
from kerbside.functions import labels, vectors
from kerbside.functions.text import hash31
from kerbside.operators import claims, cloud, documents, media
from kerbside.plans.catalog import query
from kerbside.plans.surveys import FLOORS, LENS, REJECTS, WORLD, cameras, pixels

# Probes: an order makes one, as text

BROKEN = "o_orderkey % 11 = 0 OR o_orderkey % 13 = 0"


@query(
    f""", p AS (SELECT o_orderkey, CASE WHEN {BROKEN} THEN 'no stream' WHEN o_orderkey % 50 = 0 OR o_orderkey % 1920 = 0 THEN 'no duration or size' END AS fault, CASE o_orderkey % 4 WHEN 1 THEN 270 WHEN 2 THEN 180 ELSE 0 END AS turn FROM orders)
SELECT o_orderkey, fault, CASE WHEN fault IS NULL THEN o_orderkey % 50 / 2.0::DOUBLE END AS duration_s, CASE WHEN fault IS NULL THEN CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 60 / (o_orderkey % 3)::DOUBLE END END AS rate, CASE WHEN fault IS NULL THEN turn END AS rotation,
 CASE WHEN fault IS NULL THEN CASE WHEN turn = 270 THEN 1080 ELSE CAST(o_orderkey % 1920 AS INT) END END AS width, CASE WHEN fault IS NULL THEN CASE WHEN turn = 270 THEN CAST(o_orderkey % 1920 AS INT) ELSE 1080 END END AS height FROM p"""
)
def media_probe(s, d):
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    turn = F.when(k % 4 == 1, ',"side_data_list":[{},{"rotation":-90}]').when(k % 4 == 2, ',"tags":{"rotate":"180"}').otherwise("")
    stream = F.concat(F.lit('{"height":1080,"width":'), text(k % 1920), F.lit(',"avg_frame_rate":"'), text(k % 60), F.lit("/"), text(k % 3), F.lit('"'), turn, F.lit("}"))
    probe = F.concat(F.lit('{"streams":['), F.when(k % 13 != 0, stream).otherwise(""), F.lit('],"format":{"duration":"'), text(k % 50 / 2), F.lit('"}}'))
    return media.media_facts(shim.table(s, d, "orders").select("o_orderkey", F.when(k % 11 == 0, "not a probe").otherwise(probe).alias("json")), ["o_orderkey"], "json")


@query(
    ", f AS (SELECT o_orderkey, unnest(range(0, o_orderkey % 5 + 1)) AS i, CASE WHEN o_orderkey % 9 = 4 AND o_orderkey % 5 >= 2 THEN 'invalid time' WHEN o_orderkey % 9 = 5 AND o_orderkey % 5 >= 3 THEN 'time runs backwards' END AS fault FROM orders WHERE o_orderkey % 7 <> 0)"
    " SELECT o_orderkey, CAST(i AS INT) AS frame, CASE WHEN fault IS NULL THEN i * 40000000 END AS at_ns, i % 2 = 0 AS key_frame, fault FROM f UNION ALL SELECT o_orderkey, NULL, NULL, false, 'no frames' FROM orders WHERE o_orderkey % 7 = 0"
)
def frame_timeline(s, d):
    k = F.col("o_orderkey")
    at = lambda i: F.when((k % 9 == 4) & (i == 2), "N/A").when((k % 9 == 5) & (i == 3), "0.010000").otherwise((k % 3 + i * 0.04).cast("decimal(12,6)").cast("string"))
    frame = lambda i: F.struct(at(i).alias("best_effort_timestamp_time"), F.when(i % 2 == 0, 1).otherwise(0).alias("key_frame"))
    made = F.to_json(F.struct(F.transform(F.sequence(F.lit(0).cast("long"), k % 5), frame).alias("frames")))
    return media.frame_timeline(shim.table(s, d, "orders").select("o_orderkey", F.when(k % 7 == 0, '{"frames":[]}').otherwise(made).alias("json")), ["o_orderkey"], "json")


# Labels, hashes and vectors

KEY = "session_id || ':' || segment_id || ':' || coalesce(window_index::VARCHAR, 'whole')"


@query(
    f""" SELECT session_id, segment_id, window_index, {KEY} AS stretch, round(start_m)::BIGINT || '-' || round(end_m)::BIGINT || ' m' AS metres,
 CASE WHEN cells % 3 = 0 THEN 'BR-101 km ' || cells ELSE coalesce(CASE WHEN cells % 3 = 1 THEN place END, round(-23.5::DOUBLE + cells / 100.0::DOUBLE, 5)::DECIMAL(9, 5) || ', ' || round(-46.6::DOUBLE + cells / 100.0::DOUBLE, 5)::DECIMAL(9, 5)) END AS place,
 nullif(array_to_string(list_filter([CASE WHEN cells % 3 = 0 AND cells % 3 <> 2 THEN place END, CASE WHEN cells % 2 = 0 THEN 'about no. ' || cells END], lambda v: v IS NOT NULL), ', '), '') AS detail,
 CASE WHEN level IS NOT NULL THEN ['low', 'medium', 'high'][level] WHEN cells = 0 AND segment_id % 2 = 0 THEN 'no vegetation found' WHEN cells = 0 THEN 'vegetation without a height' WHEN cells > 0 THEN 'too little evidence' ELSE 'not assessed' END AS state FROM readings"""
)
def reading_labels(s, d):
    from kerbside.plans.catalog import source

    r, c = source(s, d), F.col("cells")
    street, at = F.when(c % 3 != 2, F.col("place")), c / 100.0
    road = F.when(c % 3 == 0, "BR-101")
    return r.select(
        "session_id", "segment_id", "window_index", labels.stretch_key(F.col("session_id"), F.col("segment_id"), F.col("window_index")).alias("stretch"), labels.stretch_range(F.col("window_index"), F.col("start_m"), F.col("end_m")).alias("metres"),
        labels.place_label(road, c, street, at - 23.5, at - 46.6).alias("place"), labels.place_detail(road, c, street, F.when(c % 2 == 0, c.cast("string")), F.lit(" ")).alias("detail"),
        labels.reading_label(F.col("level"), c, F.col("segment_id") % 2).alias("state"),
    )


@query(", f AS (SELECT session_id, place, min(captured_at) AS first FROM readings WHERE place IS NOT NULL GROUP BY 1, 2), l AS (SELECT session_id, arg_min(place, (first, place)) AS place, count(*) AS n FROM f GROUP BY 1) SELECT session_id, place || CASE WHEN n > 1 THEN ' and ' || (n - 1) || ' more' ELSE '' END AS place FROM l")
def session_labels(s, d):
    from kerbside.plans.catalog import source

    first = source(s, d).where("place IS NOT NULL").groupBy("session_id", "place").agg(F.min("captured_at").alias("first"))
    g = first.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("first", "place"))).alias("p"))
    return g.select("session_id", labels.places_label(F.transform("p", lambda p: p["place"])).alias("place"))


HASH = "list_reduce(list_prepend(0::UBIGINT, list_transform(string_split({}, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (h * 31 + c) % 4294967296)"


@query(f", h AS (SELECT coalesce(level, 0) AS level, {HASH.format(KEY)} % 16 AS bucket FROM readings) SELECT level, bucket::BIGINT AS bucket, count(*) AS n FROM h GROUP BY 1, 2")
def stretch_hash_buckets(s, d):
    """How readings fall into buckets by the hash of their stretch's key."""
    from kerbside.plans.catalog import source

    key = labels.stretch_key(F.col("session_id"), F.col("segment_id"), F.col("window_index"))
    return source(s, d).select(F.coalesce("level", F.lit(0)).alias("level"), (hash31(key) % 16).alias("bucket")).groupBy("level", "bucket").agg(F.count("*").alias("n"))


SEED = "CASE WHEN abs(x) <= abs(y) AND abs(x) <= abs(z) THEN [0, -z, y] WHEN abs(y) <= abs(z) THEN [z, 0, -x] ELSE [-y, x, 0] END"


@query(
    f""", u AS (SELECT point_id, x, y, z, sqrt(x * x + y * y + z * z) AS s, {SEED} AS e FROM points), v AS (SELECT *, list_transform(e, lambda k: k / sqrt(list_sum(list_transform(e, lambda q: q * q)))) AS f FROM u)
SELECT point_id, round(degrees(acos(greatest(-1, least(1, (x * 0.36 + y * 0.8 + z * 0.48) / s)))), 6) + 0 AS angle, round(f[1], 6) + 0 AS first_x, round(f[2], 6) + 0 AS first_y, round(f[3], 6) + 0 AS first_z,
 round((y * f[3] - z * f[2]) / s, 6) + 0 AS second_x, round((z * f[1] - x * f[3]) / s, 6) + 0 AS second_y, round((x * f[2] - y * f[1]) / s, 6) + 0 AS second_z, round(y - (x * 0.36 + y * 0.8 + z * 0.48 + 0.1) / 0.8, 6) + 0 AS elevation FROM v"""
)
def vector_frames(s, d):
    a = vectors.vector(F.col("x"), F.col("y"), F.col("z"))
    normal, up = vectors.vector(F.lit(0.36), F.lit(0.8), F.lit(0.48)), vectors.vector(F.lit(0), F.lit(2), F.lit(0))
    p = shim.points(s, d).withColumns({"angle": vectors.angle_deg(a, normal), "elevation": vectors.elevation_at(normal, F.lit(0.1), a, up), "axes": vectors.across(a)})
    told = {"angle": "angle", "elevation": "elevation"} | {f"{e}_{c}": f"axes.{e}.{c}" for e in ("first", "second") for c in vectors.AXES}
    return p.select("point_id", *((F.round(c, 6) + F.lit(0.0)).alias(n) for n, c in told.items()))


# Claims and exports

DAYS = 3 * 86400


@query(
    ", a AS (SELECT session_id, event_id, t // 1000000000 AS asked, row_number() OVER (PARTITION BY session_id ORDER BY t // 1000000000, event_id) AS i FROM moments), f AS (SELECT * FROM (WITH RECURSIVE r AS (SELECT session_id, event_id, asked, i, asked AS held, 'taken' AS fate FROM a WHERE i = 1 UNION ALL"
    f" SELECT a.session_id, a.event_id, a.asked, a.i, CASE WHEN a.asked - held > {DAYS} THEN a.asked ELSE held END, CASE WHEN a.asked - held > {DAYS} THEN 'expired' ELSE 'held' END FROM r JOIN a ON a.session_id = r.session_id AND a.i = r.i + 1) SELECT * FROM r)) SELECT session_id, event_id, asked, fate FROM f"
)
def claims_with_expiry(s, d):
    tried = shim.moments(s, d).select("session_id", "event_id", F.floor(F.col("t") / 1000000000).alias("asked"))
    return claims.claims(tried, ["session_id"], "asked", "event_id", DAYS)


@query(
    ", v AS (SELECT session_id, count(*) AS n FROM (SELECT session_id, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM fixes WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id)) WHERE plat IS NULL OR plat <> lat OR plon <> lon GROUP BY 1)"
    " SELECT session_id, kind, CASE kind WHEN 'track' THEN 'LineString' ELSE 'Polygon' END AS type, CASE kind WHEN 'track' THEN n END AS vertices, device, road, started_at IS NULL AS not_started, 'not-ready' AS status FROM v JOIN sessions USING (session_id), (SELECT unnest(['track', 'band']) AS kind) WHERE n >= 2"
)
def geojson_features(s, d):
    """Read back from the features' text."""
    f = shim.fixes(s, d).withColumn("ord", F.struct("t", "event_id"))
    shapes = documents.track(f, "session_id", "ord").join(documents.band_polygon(f, "session_id", "ord", 5.0), "session_id", "left")
    told = documents.reading_features(shapes.join(shim.sessions(s, d), "session_id"), ["session_id"], "line", "geometry", ["session_id", "device", "road", "started_at"])
    at = lambda p: F.get_json_object("feature", p)
    vertices = F.when(F.col("kind") == "track", F.size(F.from_json(at("$.geometry.coordinates"), "array<array<double>>")).cast("long"))
    unknown = F.contains(F.col("feature"), F.lit('"started_at":null'))
    return told.select("session_id", at("$.properties.kind").alias("kind"), at("$.geometry.type").alias("type"), vertices.alias("vertices"), at("$.properties.device").alias("device"), at("$.properties.road").alias("road"), unknown.alias("not_started"), at("$.properties.operationalStatus").alias("status"))


@query(
    ", t AS (SELECT n_regionkey AS clip, l_orderkey % 40 AS run, l_suppkey AS item, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem JOIN nation ON n_nationkey = l_orderkey % 40 GROUP BY 1, 2, 3) SELECT clip::BIGINT AS clip, run, item, n, mean, sd, count(DISTINCT run) OVER (PARTITION BY clip) AS runs FROM t"
)
def session_export(s, d):
    """Read back from the documents: the trials of a clip's runs."""
    trials = shim.table(s, d, "lineitem").select((F.col("l_orderkey") % 40).alias("run"), F.col("l_suppkey").alias("item"), "l_quantity")
    runs = shim.table(s, d, "nation").select(F.col("n_regionkey").cast("long").alias("clip"), F.col("n_nationkey").cast("long").alias("run"))
    told = documents.session_export(trials, runs, "clip", "run", "item", "l_quantity")
    back = F.from_json("document", "clipKey long, runIds array<long>, repeatability array<struct<run: long, item: long, n: long, mean: double, sd: double>>")
    return told.select(back.alias("b")).select(F.col("b.clipKey").alias("clip"), F.size("b.runIds").cast("long").alias("runs"), F.explode("b.repeatability").alias("r")).select("clip", "runs", "r.*")


# Clouds

EDGE = 0.3719
RANKS = ", b AS (SELECT frame, floor(conf * 20) AS bin, count(*) AS n FROM pixels GROUP BY 1, 2), k AS (SELECT frame, bin, sum(n) OVER (PARTITION BY frame ORDER BY bin) / sum(n) OVER (PARTITION BY frame) AS w FROM b)"
USED = ", used AS (SELECT j.frame, r, c, depth, w FROM rejects j JOIN floors ON floors.frame = j.frame AND conf >= middle JOIN k ON k.frame = j.frame AND k.bin = floor(conf * 20) WHERE reject IS NULL)"


@query(
    REJECTS + FLOORS + RANKS + USED + WORLD.format(rows="used")
    + f", v AS (SELECT {', '.join(f'floor({c} / {EDGE}::DOUBLE)::BIGINT AS v{c}' for c in 'xyz')}, {', '.join(f'sum({c} * w) / sum(w) AS m{c}' for c in 'xyz')}, avg(w) AS weight, count(*) AS n FROM world GROUP BY 1, 2, 3)"
    + " SELECT vx, vy, vz, round(mx, 6) AS x, round(my, 6) AS y, round(mz, 6) AS z, n, round(weight / avg(weight) OVER (), 6) AS weight FROM v"
)
def cloud_build(s, d):
    built = cloud.build(pixels(s, d), cameras(s, d), LENS, 1.3, 1.5, "by_rank", EDGE)
    return built.select("vx", "vy", "vz", *(F.round(c, 6).alias(c) for c in ("x", "y", "z", "weight")), "n")


@query(", p AS (SELECT point_id, point_id % 3 AS g, row_number() OVER (PARTITION BY point_id % 3 ORDER BY point_id) - 1 AS i, greatest(1, ceil(count(*) OVER (PARTITION BY point_id % 3) / 30)) AS k FROM points) SELECT point_id, g FROM p WHERE i % k = 0")
def strided_cap(s, d) -> DataFrame:
    return cloud.strided(shim.points(s, d).select("point_id", (F.col("point_id") % 3).alias("g")), ["g"], "point_id", 30)
