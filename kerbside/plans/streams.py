"""Streams over the test tables as named queries, each run until its input is used up, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside import shim
from kerbside.operators.stages import shared_folder
from kerbside.plans.catalog import HAVERSINE, ORACLES, query
from kerbside.plans.records import DAYS
from kerbside.streaming import backfill, claims, messages, sessions


def folder(s: SparkSession, label: str) -> str:
    return f"{shared_folder(s)}/kerbside/{s.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


#: Files in which a part of a stream's input arrives.
FILES = 8


def arriving(df: DataFrame, key: str, order: str, parts: int, path: str) -> None:
    """Write df in parts of FILES files at most that appear one after the other, in order; a part has a key in one file."""
    cuts = df.select(F.expr(f"percentile_approx({order}, array({', '.join(str(k / parts) for k in range(1, parts))}), 10000)").alias("c")).first().c or []
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges, edges[1:], strict=False):
        part = df.where(F.lit(True) if low is None else F.col(order) > low).where(F.lit(True) if high is None else F.col(order) <= high)
        part.repartition(FILES, key).write.mode("append").parquet(path)


def run_out(stream: DataFrame, path: str) -> DataFrame:
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


@query(ORACLES["claims_with_expiry"].removeprefix(shim.PROLOGUE))
def claims_stream(s, d):
    """claims_with_expiry, told by a stream in which the attempts arrive in four parts."""
    tried = shim.moments(s, d).select("session_id", "event_id", F.floor(F.col("t") / 1000000000).cast("long").alias("asked"))
    path = folder(s, "claims")
    arriving(tried, "session_id", "asked", 4, f"{path}/in")
    source = s.readStream.schema(tried.schema).option("maxFilesPerTrigger", FILES).parquet(f"{path}/in")
    return run_out(claims.claims(source, "session_id", "asked", "event_id", DAYS), path).withColumnRenamed("attempt", "event_id").select("session_id", "asked", "event_id", "fate")


APART = HAVERSINE.format(a="p", b="")


@query(
    ", f AS (SELECT *, lag(t) OVER w AS pt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM fixes WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id)), g AS (SELECT *, t - pt > 172800000000000 OR pt IS NULL AS fresh FROM f), n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY session_id ORDER BY t, event_id) AS run FROM g)"
    + f" SELECT session_id, make_timestamp(min(t) // 1000) AS first_at, make_timestamp(max(t) // 1000) AS last_at, count(*) AS fixes, round(sum(CASE WHEN fresh THEN 0 ELSE {APART} END), 4) AS metres FROM n GROUP BY session_id, run"
)
def device_sessions(s, d):
    """Sessions end after two days without a fix."""
    f = shim.fixes(s, d).withColumn("at", F.timestamp_micros(F.expr("t div 1000")))
    found = sessions.device_sessions(f, "session_id", "event_id", "2 days")
    return found.select("session_id", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("last_at").cast("timestamp_ntz").alias("last_at"), "fixes", F.round("metres", 4).alias("metres"))


#: Rows that a tick of the backfill takes.
MOST = 40
_TICKS = [
    f"t{n} AS (SELECT segment_id, {n} AS batch FROM p {''.join(f'ANTI JOIN d{k} USING (segment_id) ' for k in range(n))}ORDER BY measured_at DESC NULLS LAST, segment_id DESC LIMIT {MOST}), d{n} AS (SELECT * FROM t{n} WHERE segment_id % 5 <> 0 OR {n} >= 2)"
    for n in range(4)
]


@query(", p AS (SELECT segment_id, measured_at FROM segments WHERE state = 'ready'), " + ", ".join(_TICKS) + " SELECT segment_id, 'street ' || segment_id % 7 AS found, batch::BIGINT AS batch FROM (" + " UNION ALL ".join(f"FROM d{n}" for n in range(4)) + ")")
def backfill_ticks(s, d):
    """Four ticks; look-ups of every fifth segment fail until the third."""
    pending, done = shim.segments(s, d).where("state = 'ready'").select("segment_id", "measured_at"), folder(s, "places")
    for number in range(4):
        ok = (F.col("segment_id") % 5 != 0) | F.lit(number >= 2)
        backfill.tick(number, pending, lambda df, ok=ok: df.withColumn("found", F.when(ok, F.concat(F.lit("street "), (F.col("segment_id") % 7).cast("string")))), done, "segment_id", "measured_at", MOST)
    return backfill.found_so_far(s, "segment_id long, found string, batch long", done)


def sent(s, d) -> DataFrame:
    """Messages for segments as JSON lines; each third one names its window."""
    k = F.col("segment_id")
    return shim.segments(s, d).select(
        F.to_json(
            F.struct(
                "session_id", k, F.when(k % 3 == 0, (k % 4).cast("int")).alias("window_index"), F.concat(F.lit("g"), (k % 2).cast("string")).alias("generation"),
                (1 + k % 3).cast("int").alias("attempt"), F.timestamp_seconds(F.lit(1700000000) + k).alias("sent_at"), (k % 5).cast("int").alias("windows"),
            )
        ).alias("value")
    )


FANNED = ", m AS (SELECT session_id, segment_id, 'g' || segment_id % 2 AS generation, CAST(1 + segment_id % 3 AS INT) AS attempt, CASE WHEN segment_id % 3 = 0 THEN [segment_id % 4] ELSE range(0, greatest(segment_id % 5, 1)) END AS ws FROM segments), w AS (SELECT session_id, segment_id, generation, attempt, CAST(unnest(ws) AS INT) AS window_index FROM m)"


@query(FANNED + " SELECT session_id, segment_id, window_index, generation, attempt FROM w")
def messages_fanned_out(s, d):
    good, _ = messages.parse(sent(s, d))
    return messages.fan_out(good).select("session_id", "segment_id", "window_index", "generation", "attempt")


@query(FANNED + ", o AS (SELECT *, CASE WHEN (segment_id + window_index) % 7 <> 0 THEN 'done' WHEN attempt < 3 THEN 'retry' ELSE 'poison' END AS fate FROM w) SELECT session_id, segment_id, window_index, generation, CAST(attempt + (fate = 'retry')::INT AS INT) AS attempt, fate FROM o")
def messages_processed(s, d):
    """Every message is delivered twice; each seventh window fails."""
    path = folder(s, "messages")
    for _ in range(2):
        sent(s, d).coalesce(1).write.mode("append").text(f"{path}/in")
    good, _ = messages.parse(messages.read(s, f"{path}/in"))
    tables = {fate: f"{path}/{fate}" for fate in ("done", "retry", "poison")}
    work = lambda df: df.withColumn("failed", (F.col("segment_id") + F.col("window_index")) % 7 == 0)
    messages.process(messages.fan_out(messages.once(good)), work, **tables, checkpoint=f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    out = [s.read.parquet(at).select("session_id", "segment_id", "window_index", "generation", "attempt", F.lit(fate).alias("fate")) for fate, at in tables.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])
