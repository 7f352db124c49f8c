"""The survey's tables, as roles of the test tables. PROLOGUE says the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside.functions.levels import level

LINE_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("session_id")).agg(F.min("o_orderdate").alias("started_at"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("device"), F.col("c_mktsegment").alias("road"))
    return c.join(first, "session_id", "left")


def segments(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "queued").otherwise("uploading")
    ready = F.col("o_orderstatus") == "F"
    s = o.select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("segment_id"), F.col("o_orderdate").alias("captured_at"), state.alias("state"),
        F.when(ready, F.col("o_orderkey") % 60 / F.lit(100.0)).alias("height"), F.when(ready, F.col("o_orderkey") % 45).alias("cells"),
        F.when(ready, F.lit("good")).alias("quality"), F.when(ready, F.concat(F.lit("street "), (F.col("o_orderkey") % 7).cast("string"))).alias("place"),
        F.when(ready, F.col("o_orderdate")).alias("measured_at"),
    )
    return s.withColumn("level", level(F.col("height"), F.col("cells")))


def windows(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    line = table(spark, d, "lineitem").withColumn("window_index", (F.row_number().over(order) - 1).cast("int"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("place"))
    placed = F.col("l_linestatus") != "O"
    quality = F.when(F.col("l_returnflag") == "A", "good").when(F.col("l_returnflag") == "R", "degraded").otherwise("unavailable")
    w = line.join(p, "l_partkey", "left").select(
        F.col("l_orderkey").alias("segment_id"), "window_index", F.when(F.col("l_discount") != 0, F.col("l_quantity") / 100).alias("height"),
        (F.col("l_partkey") % 40).alias("cells"), F.when(placed, F.col("window_index") * 25.0).alias("start_m"), F.when(placed, (F.col("window_index") + 1) * 25.0).alias("end_m"),
        quality.alias("quality"), "place", F.col("l_shipdate").alias("measured_at"),
    )
    return w.withColumn("level", level(F.col("height"), F.col("cells")))


def fixes(spark: SparkSession, d: str) -> DataFrame:
    """Position fixes: clicks and views, in nanoseconds of a session's clock."""
    return moments(spark, d).where(F.col("kind").isin("click", "view")).drop("kind")


def motions(spark: SparkSession, d: str) -> DataFrame:
    return moments(spark, d).where(~F.col("kind").isin("click", "view")).drop("kind")


def moments(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("session_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("t"), (F.col("value") / 20).alias("speed"), F.col("event_type").alias("kind"), (F.col("value") % 40).alias("accuracy"), (F.col("event_id") % 360).cast("double").alias("course"), (F.lit(-23.5) + F.col("event_id") % 997 / F.lit(10000.0)).alias("lat"), (F.lit(-46.6) + F.col("event_id") % 991 / F.lit(10000.0)).alias("lon"))


def votes(spark: SparkSession, d: str) -> DataFrame:
    """Heights seen in (cell, frame)."""
    return table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("cell"), (F.col("l_suppkey") % 12).alias("frame"), (F.col("l_orderkey") % 90).alias("voxel"), (F.col("l_quantity") / 100).alias("height"))


def points(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k: F.element_at("embedding", k).cast("double")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), (F.lit(1.0) + F.coalesce("label", F.lit(0))).alias("w"))


def markers(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select(F.col("n_name").alias("marker"), F.col("n_nationkey").alias("km"), (F.lit(-23.5) + F.col("n_nationkey") * 0.004).alias("mlat"), (F.lit(-46.6) + F.col("n_nationkey") * 0.004).alias("mlon"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Work orders of teams."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").otherwise("scheduled")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") % 100).alias("team_id"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("created_at"), "o_totalprice")


PROLOGUE = """
WITH sessions AS (SELECT c_custkey AS session_id, c_name AS device, c_mktsegment AS road, f.started_at FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS started_at FROM orders GROUP BY 1) f ON o_custkey = c_custkey),
seg0 AS (SELECT o_custkey AS session_id, o_orderkey AS segment_id, o_orderdate AS captured_at, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'queued' ELSE 'uploading' END AS state,
 CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 60 / 100.0::DOUBLE END AS height, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 45 END AS cells, CASE WHEN o_orderstatus = 'F' THEN 'good' END AS quality,
 CASE WHEN o_orderstatus = 'F' THEN 'street ' || (o_orderkey % 7) END AS place, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS measured_at FROM orders),
segments AS (SELECT *, CASE WHEN height IS NULL OR coalesce(cells, 0) < 20 THEN NULL WHEN height > 0.30 THEN 3 WHEN height >= 0.10 THEN 2 ELSE 1 END AS level FROM seg0),
win0 AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INT) AS window_index FROM lineitem),
win1 AS (SELECT l_orderkey AS segment_id, window_index, CASE WHEN l_discount <> 0 THEN l_quantity / 100 END AS height, l_partkey % 40 AS cells, CASE WHEN l_linestatus <> 'O' THEN window_index * 25.0::DOUBLE END AS start_m, CASE WHEN l_linestatus <> 'O' THEN (window_index + 1) * 25.0::DOUBLE END AS end_m,
 CASE l_returnflag WHEN 'A' THEN 'good' WHEN 'R' THEN 'degraded' ELSE 'unavailable' END AS quality, p_name AS place, l_shipdate AS measured_at FROM win0 LEFT JOIN part ON p_partkey = l_partkey),
windows AS (SELECT *, CASE WHEN height IS NULL OR coalesce(cells, 0) < 20 THEN NULL WHEN height > 0.30 THEN 3 WHEN height >= 0.10 THEN 2 ELSE 1 END AS level FROM win1),
readings AS (SELECT session_id, s.segment_id, CAST(NULL AS INT) AS window_index, captured_at, height, cells, level, quality, place, measured_at, CAST(NULL AS DOUBLE) AS start_m, CAST(NULL AS DOUBLE) AS end_m FROM segments s
  WHERE measured_at IS NOT NULL AND NOT EXISTS (SELECT 1 FROM windows w WHERE w.segment_id = s.segment_id)
 UNION ALL SELECT s.session_id, s.segment_id, w.window_index, s.captured_at, w.height, w.cells, w.level, w.quality, w.place, w.measured_at, w.start_m, w.end_m FROM windows w JOIN segments s USING (segment_id)),
moments AS (SELECT user_id AS session_id, event_id, epoch_us(ts) * 1000 AS t, value / 20 AS speed, event_type AS kind, value % 40 AS accuracy, CAST(event_id % 360 AS DOUBLE) AS course, -23.5::DOUBLE + event_id % 997 / 10000.0::DOUBLE AS lat, -46.6::DOUBLE + event_id % 991 / 10000.0::DOUBLE AS lon FROM events),
fixes AS (SELECT * EXCLUDE (kind) FROM moments WHERE kind IN ('click', 'view')),
motions AS (SELECT * EXCLUDE (kind) FROM moments WHERE kind NOT IN ('click', 'view')),
votes AS (SELECT l_partkey % 50 AS cell, l_suppkey % 12 AS frame, l_orderkey % 90 AS voxel, l_quantity / 100 AS height FROM lineitem),
points AS (SELECT vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, 1.0::DOUBLE + coalesce(label, 0) AS w FROM embeddings),
markers AS (SELECT n_name AS marker, n_nationkey AS km, -23.5::DOUBLE + n_nationkey * 0.004::DOUBLE AS mlat, -46.6::DOUBLE + n_nationkey * 0.004::DOUBLE AS mlon FROM nation),
worders AS (SELECT o_orderkey AS order_id, o_custkey % 100 AS team_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'scheduled' END AS status, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_orderdate AS created_at, o_totalprice FROM orders)
"""
