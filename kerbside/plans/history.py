"""Orders with what they were opened on and their history, places on a road, canonical texts and samples, as named
queries with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside import shim
from kerbside.functions.canonical import canonical_json
from kerbside.operators import places, planes, work
from kerbside.plans.catalog import HAVERSINE, query


def day(c: str, n: int):
    return F.date_add(F.col(c).cast("date"), n)


def events(s, d) -> DataFrame:
    """An order is opened, scheduled three days later and done after ten, as far as its status says."""
    k = F.col("order_id") * 3
    steps = F.array(F.struct(k.alias("event_id"), day("created_at", 0).alias("at"), F.lit("open").alias("status"), F.lit(None).cast("string").alias("note")), F.struct((k + 1).alias("event_id"), day("created_at", 3).alias("at"), F.lit("scheduled").alias("status"), F.concat(F.lit("team "), F.col("team_id").cast("string")).alias("note")), F.struct((k + 2).alias("event_id"), day("created_at", 10).alias("at"), F.lit("done").alias("status"), F.lit(None).cast("string").alias("note")))
    reached = F.when(F.col("status") == "done", 3).when(F.col("status") == "scheduled", 2).otherwise(1)
    return shim.orders(s, d).select("order_id", F.explode(F.slice(steps, F.lit(1), reached)).alias("e")).select("order_id", "e.*")


EVENTS = ", ev AS (SELECT order_id, order_id * 3 + k AS event_id, CAST(created_at AS DATE) + [0, 3, 10][k + 1] AS on_, ['open', 'scheduled', 'done'][k + 1] AS status, CASE WHEN k = 1 THEN 'team ' || team_id END AS note FROM worders, (SELECT unnest([0, 1, 2]) AS k) WHERE k < CASE status WHEN 'done' THEN 3 WHEN 'scheduled' THEN 2 ELSE 1 END)"


@query(EVENTS + ", top AS (SELECT * FROM worders ORDER BY created_at DESC, order_id DESC LIMIT 50), t AS (SELECT segment_id AS order_id, string_agg(window_index || ':' || coalesce(level, 0), ',' ORDER BY window_index) AS targets FROM windows GROUP BY 1), h AS (SELECT order_id, string_agg(strftime(on_, '%Y-%m-%d') || ' ' || status || coalesce(' ' || note, ''), ', ' ORDER BY on_, event_id) AS events FROM ev GROUP BY 1) SELECT order_id, status, coalesce(targets, '') AS targets, coalesce(events, '') AS events FROM top LEFT JOIN t USING (order_id) LEFT JOIN h USING (order_id)")
def orders_page_history(s, d):
    targets = shim.windows(s, d).select(F.col("segment_id").alias("order_id"), F.col("window_index").alias("position"), F.coalesce("level", F.lit(0)).alias("window_level"))
    page = work.with_history(work.nested_page(shim.orders(s, d), targets, 50), events(s, d))
    listed = F.array_join(F.transform("events", lambda e: F.concat_ws(" ", e["at"].cast("string"), e["status"], e["note"])), ", ")
    return page.select("order_id", "status", F.array_join(F.transform("targets", lambda t: F.concat_ws(":", t["position"].cast("string"), t["window_level"].cast("string"))), ",").alias("targets"), listed.alias("events"))


def drafts(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every customer drafts an order for segments of two customers' numbers."""
    q = F.col("c_custkey")
    made = shim.table(s, d, "customer").select(q.alias("order_id"), F.timestamp_seconds(F.lit(1700000000) + q * 60).cast("timestamp_ntz").alias("opened_at"))
    at = shim.segments(s, d).where("segment_id % 4 < 2").select((F.col("session_id") - F.col("segment_id") % 2).alias("order_id"), F.dense_rank().over(_by_order()).alias("position"), "session_id", "segment_id", F.lit(None).cast("int").alias("window_index"))
    measured = shim.segments(s, d).where("measured_at IS NOT NULL").select("session_id", "segment_id", F.lit(None).cast("int").alias("window_index"), "level", "place", F.lit(0.0).alias("start_m"), F.when(F.col("cells") % 3 != 0, F.col("cells") * 5.0).alias("end_m"), (F.col("cells") / 8.0 - 23).alias("lat"), (F.col("cells") / 4.0 - 46).alias("lon"))
    return made, at, measured


def _by_order():
    from pyspark.sql import Window

    return Window.partitionBy(F.col("session_id") - F.col("segment_id") % 2).orderBy("session_id", "segment_id")


DRAFTS = ", tg AS (SELECT session_id - segment_id % 2 AS order_id, dense_rank() OVER (PARTITION BY session_id - segment_id % 2 ORDER BY session_id, segment_id) AS position, session_id, segment_id FROM segments WHERE segment_id % 4 < 2), rd AS (SELECT session_id, segment_id, level, place, CASE WHEN cells % 3 <> 0 THEN cells * 5.0::DOUBLE END AS end_m, cells / 8.0::DOUBLE - 23 AS lat, cells / 4.0::DOUBLE - 46 AS lon, true AS there FROM segments WHERE measured_at IS NOT NULL), mt AS (SELECT tg.*, level, place, end_m, lat, lon, coalesce(there, false) AS there FROM tg LEFT JOIN rd USING (session_id, segment_id))"


@query(DRAFTS + ", fz AS (SELECT order_id, sum(coalesce(end_m, 150)) * 10 AS area_m2, max(level) AS worst, avg(lat) AS lat, avg(lon) AS lon, count(*) AS n_targets, arg_min(place, position) AS place FROM mt GROUP BY 1 HAVING bool_and(there)) SELECT c_custkey AS order_id, make_timestamp((1700000000 + c_custkey * 60) * 1000000) AS opened_at, area_m2, worst, round(lat, 6) AS lat, round(lon, 6) AS lon, n_targets, place, 'open' AS status FROM customer JOIN fz ON order_id = c_custkey")
def orders_opened(s, d):
    orders, _, _ = work.opened(*drafts(s, d))
    return orders.withColumns({c: F.round(c, 6) for c in ("lat", "lon")})


@query(DRAFTS + " SELECT order_id, position, session_id, segment_id FROM mt WHERE NOT there")
def order_targets_not_measured(s, d):
    _, _, faults = work.opened(*drafts(s, d))
    return faults.select("order_id", F.col("position").cast("long").alias("position"), "session_id", "segment_id")


ROAD = ", an AS (SELECT km / 2.0::DOUBLE AS km, mlat AS lat, mlon + km % 3 * 0.002::DOUBLE AS lon FROM markers WHERE km % 4 = 0), al AS (SELECT *, lead(km) OVER w AS km_b, lead(lat) OVER w AS lat_b, lead(lon) OVER w AS lon_b FROM an WINDOW w AS (ORDER BY km)), sk AS (SELECT *, unnest(range(ceil(km * 10)::BIGINT, floor(km_b * 10)::BIGINT + 1)) AS k FROM al WHERE km_b > km), sp AS (SELECT k / 10::DOUBLE AS km, min(lat + (k / 10::DOUBLE - km) / (km_b - km) * (lat_b - lat)) AS mlat, min(lon + (k / 10::DOUBLE - km) / (km_b - km) * (lon_b - lon)) AS mlon FROM sk GROUP BY 1)"


@query(ROAD + ", c AS (SELECT event_id, lat, lon, sp.km, round(" + HAVERSINE.format(a="", b="m") + ", 6) AS dist FROM fixes, sp), b AS (SELECT event_id, lat, lon, arg_min(km, (dist, km)) AS km, min(dist) / 1000 AS away FROM c GROUP BY 1, 2, 3) SELECT event_id, CASE WHEN away <= 0.5 THEN km END AS km, round(away, 6) AS distance_km, away <= 0.5 AS on_road, CASE WHEN away <= 0.5 THEN 'Ring · KM ' || printf('%.1f', km) ELSE printf('%.4f° ', abs(lat)) || 'S · ' || printf('%.4f° ', abs(lon)) || 'W' END AS label FROM b")
def place_on_road(s, d):
    k = F.col("km")
    anchors = shim.markers(s, d).where(k % 4 == 0).select((k / 2.0).alias("km"), F.col("mlat").alias("lat"), (F.col("mlon") + k % 3 * 0.002).alias("lon"))
    found = places.described(shim.fixes(s, d).select("event_id", "lat", "lon"), anchors, "Ring")
    return found.select("event_id", "km", F.round("distance_km", 6).alias("distance_km"), "on_road", "label")


@query("SELECT o_orderkey AS order_id, sha256('{\"a\":{\"b\":[' || CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey // 4 AS VARCHAR) ELSE CAST(o_orderkey / 4 AS VARCHAR) END || ',null],\"c\":\"' || o_orderstatus || '\\n\"},\"z\":' || o_custkey || '}') AS key FROM orders")
def canonical_json_keys(s, d):
    """Half of the texts write their keys in another order, and numbers with more places."""
    q = F.col("o_orderkey")
    number, status, who = F.format_string("%.3f", q / 4.0), F.concat(F.lit('"'), "o_orderstatus", F.lit('\\n"')), F.col("o_custkey").cast("string")
    one = F.concat(F.lit('{"z": '), who, F.lit(', "a": {"c": '), status, F.lit(', "b": ['), number, F.lit(", null]}}"))
    other = F.concat(F.lit('{"a":{"b":['), number, F.lit(',null],"c":'), status, F.lit('},\n "z":'), who, F.lit(".0}"))
    text = F.when(q % 2 == 0, one).otherwise(other)
    return shim.table(s, d, "orders").select(q.alias("order_id"), F.sha2(canonical_json(text), 256).alias("key"))


@query("SELECT l_suppkey % 7 AS g, l_orderkey * 10 + l_linenumber AS k FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey % 7 ORDER BY md5('5:' || (l_orderkey * 10 + l_linenumber)), l_orderkey * 10 + l_linenumber) <= 100")
def grouped_samples(s, d):
    rows = shim.table(s, d, "lineitem").select((F.col("l_suppkey") % 7).alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return planes.least_hashes(rows, ["g"], "k", 100, 5)
