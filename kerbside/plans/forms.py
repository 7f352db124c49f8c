"""Forms of text, days, sizes and numbers as named queries, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside import shim
from kerbside.functions import dates, geo, text, vectors
from kerbside.operators import sampling
from kerbside.plans.catalog import query


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN upper(trim(c_name)) END AS code, c_custkey % 4 <> 0 AND length(trim(c_name)) > 17 AS too_long, 'frame_' || lpad(c_custkey::VARCHAR, 8, '0') || '.jpg' AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS filled, array_to_string(list_transform(string_split_regex(lower(c_mktsegment) || ' of ' || c_name, '\\s+')[1:2], lambda w: upper(w[1:1])), '') AS initials,"
    " 'f-' || printf('%.6f', c_custkey / 64.0::DOUBLE) || '-' || printf('%.6f', -c_custkey / 32.0::DOUBLE) AS place, substr(sha256('40x30:' || c_custkey || ',' || c_custkey % 7), 1, 16) AS digest, CASE WHEN c_custkey * 16 >= 10000 THEN printf('%.2f', c_custkey * 16 / 10000.0::DOUBLE) || ' ha' ELSE c_custkey * 16 || ' m²' END AS area, CASE WHEN c_custkey < 1000 THEN c_custkey || ' m' ELSE printf('%.1f', (c_custkey + 50) // 100 / 10.0::DOUBLE) || ' km' END AS distance FROM customer"
)
def text_forms(s, d):
    k = F.col("c_custkey")
    code, long = text.code(F.when(k % 4 != 0, F.concat(F.lit("  "), "c_name", F.lit(" "))).otherwise("  "), 17)
    filled = text.first_filled(F.when(k % 3 == 0, F.lit(" ")), F.when(k % 3 == 0, F.col("c_mktsegment")), F.col("c_name"))
    return shim.table(s, d, "customer").select(
        "c_custkey", code.alias("code"), long.alias("too_long"), text.numbered("frame_", k, 8, ".jpg").alias("name"), filled.alias("filled"),
        text.initials(F.concat(F.lower("c_mktsegment"), F.lit("  of "), "c_name")).alias("initials"), text.place_id(k / 64.0, -k / 32.0).alias("place"),
        text.mask_digest(F.lit(40), F.lit(30), F.array(k, k % 7)).alias("digest"), text.area_text(k * 16.0).alias("area"), text.distance_text(k / 1000.0).alias("distance"),
    )


#: Sao Paulo has kept to three hours behind UTC since 2019; its offset is written out in the SQL.
ZONE = "America/Sao_Paulo"


@query(
    ", e AS (SELECT event_id, ts, ts - INTERVAL 3 HOUR AS local FROM events) SELECT event_id, strftime(local, '%Y-%m-%d') AS day, CAST(date_trunc('week', local) AS DATE) AS week, strftime(ts, '%Y%m') AS month, date_trunc('day', local) + INTERVAL 3 HOUR AS begins, date_trunc('day', local) + INTERVAL 75 HOUR AS ended, make_timestamp(epoch_us(ts) + event_id * 777 // 1000) AS after FROM e"
)
def date_forms(s, d):
    at = F.col("ts").cast("timestamp")
    begins, ended = dates.day_bounds(dates.day_key(at, ZONE), F.date_add(dates.day_key(at, ZONE).cast("date"), 2), ZONE)
    plain = lambda c: c.cast("timestamp_ntz")
    return shim.table(s, d, "events").select("event_id", dates.day_key(at, ZONE).alias("day"), dates.week_start(at, ZONE).alias("week"), dates.month_key(at).alias("month"), plain(begins).alias("begins"), plain(ended).alias("ended"), plain(dates.instant_after(at, F.col("event_id") * 777)).alias("after"))


@query(
    ", p AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 360 >= 315 OR p_partkey % 360 < 45 THEN 'north' WHEN p_partkey % 360 < 135 THEN 'east' WHEN p_partkey % 360 < 225 THEN 'south' ELSE 'west' END AS facing, p_size * 40 AS w, p_partkey % 1100 AS h FROM part), q AS (SELECT *, greatest(w, h) AS l FROM p)"
    " SELECT p_partkey, facing, CAST(CASE WHEN l <= 504 THEN w ELSE greatest(2, floor(w * (504 / l::DOUBLE) / 2 + 0.5) * 2) END AS INT) AS width, CAST(CASE WHEN l <= 504 THEN h ELSE greatest(2, floor(h * (504 / l::DOUBLE) / 2 + 0.5) * 2) END AS INT) AS height,"
    " CASE WHEN p_size - 3 >= 32 THEN array_to_string(range(1, p_size - 2), ' ') WHEN p_size - 3 <= 0 THEN '' ELSE array_to_string(list_transform(range(0, p_size - 3), lambda i: floor(i * 31 / greatest(p_size - 4, 1)::DOUBLE + 0.5)::INT + 1), ' ') END AS picked FROM q"
)
def size_forms(s, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    width, height = geo.scaled_size(size * 40, k % 1100, 504)
    picked = F.array_join(F.transform(sampling.even_numbers(size - 3, 32), lambda i: i.cast("string")), " ")
    return shim.table(s, d, "part").select("p_partkey", geo.cardinal((k % 360).cast("double")).alias("facing"), width.alias("width"), height.alias("height"), picked.alias("picked"))


@query(", t AS (SELECT point_id, -2 * y AS tx, 2 * x AS ty, 2 * z AS tz FROM points), n AS (SELECT *, sqrt(tx * tx + ty * ty + tz * tz) AS l FROM t) SELECT point_id, round(tx / l, 6) + 0 AS x, round(ty / l, 6) + 0 AS y, round(tz / l, 6) + 0 AS z FROM n")
def turned_directions(s, d):
    """Directions under a matrix that turns, scales and moves: moves and scales do not count."""
    m = F.array(*(F.lit(v) for r in ([0.0, -2.0, 0.0, 1.0], [2.0, 0.0, 0.0, -3.0], [0.0, 0.0, 2.0, 0.5], [0.0, 0.0, 0.0, 2.0]) for v in r))
    found = shim.points(s, d).select("point_id", vectors.turned(m, vectors.vector(F.col("x"), F.col("y"), F.col("z"))).alias("t"))
    return found.select("point_id", *((F.round(F.col("t")[c], 6) + F.lit(0.0)).alias(c) for c in vectors.AXES))
