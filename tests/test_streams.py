"""Streams against batches: claims over a restart, sessions from shuffled input, backfill that tries again."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from kerbside.operators import claims as batch_claims
from kerbside.streaming import backfill, claims, sessions


def drop_in(spark, rows, columns, folder):
    spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(folder)


def run(stream, folder, check, name="q", **trigger):
    q = stream.writeStream.queryName(name).format("parquet").option("path", folder).option("checkpointLocation", check).trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return q


def test_claims_go_on_after_a_restart(spark, tmp_path):
    into, out, check = (f"file://{tmp_path}/{k}" for k in ("in", "out", "check"))
    dice = random.Random(2)
    rows = sorted((dice.randint(0, 300), dice.randint(1, 6), k) for k in range(120))
    columns = "asked long, k int, id long"
    for part in range(3):  # each run is a new stream over the same checkpoint
        drop_in(spark, rows[40 * part : 40 * part + 40], columns, into)
        source = spark.readStream.schema(columns).parquet(into)
        run(claims.claims(source, "k", "asked", "id", 30), out, check)
    got = sorted((r.k, r.asked, r.attempt, r.fate) for r in spark.read.parquet(out).collect())
    whole = batch_claims.claims(spark.createDataFrame(rows, columns), ["k"], "asked", "id", 30)
    assert got == sorted((r.k, r.asked, r.id, r.fate) for r in whole.collect())
    run(claims.claims(spark.readStream.schema(columns).parquet(into), "k", "asked", "id", 30), out, check)
    assert spark.read.parquet(out).count() == 120  # nothing is told twice


def test_a_holder_is_told_the_same_again(spark, tmp_path):
    into, out, check = (f"file://{tmp_path}/{k}" for k in ("in", "out", "check"))
    for row in ((5, 1, 7), (6, 1, 8), (5, 1, 7), (None, 1, 9)):
        drop_in(spark, [row], "asked long, k int, id long", into)
        run(claims.claims(spark.readStream.schema("asked long, k int, id long").parquet(into), "k", "asked", "id", 30), out, check)
    assert sorted((r.attempt, r.fate) for r in spark.read.parquet(out).collect()) == [(7, "taken"), (7, "taken"), (8, "held")]


def test_claims_expire_by_the_clock(spark, tmp_path):
    into, out, check = (f"file://{tmp_path}/{k}" for k in ("in", "out", "check"))
    columns = "asked long, k int, id long"
    drop_in(spark, [(0, 1, 1)], columns, into)
    stream = claims.claims(spark.readStream.schema(columns).parquet(into), "k", "asked", "id", 2500, own_clock=True)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(processingTime="500 milliseconds").start()

    def told(n):
        end = time.time() + 60
        while time.time() < end:
            try:
                rows = spark.read.schema("k int, asked long, attempt long, fate string").parquet(out).collect()
            except Exception:
                rows = []
            if len(rows) >= n:
                return rows
            time.sleep(0.3)
        raise AssertionError(rows)

    try:
        told(1)
        drop_in(spark, [(0, 1, 2)], columns, into)
        told(3)  # held, and then released by the timer
        drop_in(spark, [(0, 1, 3)], columns, into)
        fates = {(r.attempt, r.fate) for r in told(4)}
    finally:
        q.stop()
    assert {(1, "taken"), (1, "released"), (3, "taken")} <= fates and (2, "held") in fates


def test_sessions_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    into, out, check = (f"file://{tmp_path}/{k}" for k in ("in", "out", "check"))
    dice, rows, at = random.Random(5), [], 1_700_000_000.0
    for k in range(300):
        at += dice.choice([1, 2, 5, 40])
        rows.append((dice.randint(1, 3), k, at, -23 + k * 1e-4, -46.0))
    columns = "device int, id long, s double, lat double, lon double"
    whole = spark.createDataFrame(rows, columns).withColumn("at", F.timestamp_seconds("s"))
    dice.shuffle(rows)
    for part in range(0, 300, 100):
        drop_in(spark, rows[part : part + 100], columns, into)
    progress = backfill.Progress()
    spark.streams.addListener(progress)
    try:
        source = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(into).withColumn("at", F.timestamp_seconds("s")).observe("seen", F.count(F.lit(1)).alias("seen"))
        run(sessions.device_sessions(source, "device", "id", "30 seconds", "1 day"), out, check, "devices")
        # A day and more later, all sessions have ended; a fix of long ago is too late.
        drop_in(spark, [(9, 900, at + 10**6, 0.0, 0.0)], columns, into)
        run(sessions.device_sessions(source, "device", "id", "30 seconds", "1 day"), out, check, "devices")
        drop_in(spark, [(1, 901, at, 0.0, 0.0)], columns, into)
        run(sessions.device_sessions(source, "device", "id", "30 seconds", "1 day"), out, check, "devices")
        end = time.time() + 20
        while time.time() < end and progress.totals["devices"]["rows"] < 302:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(progress)
    key = lambda r: (r.device, r.first_at, r.last_at, r.fixes, round(r.metres, 6))
    want = sorted(map(key, sessions.device_sessions(whole, "device", "id", "30 seconds").collect()))
    assert sorted(map(key, spark.read.parquet(out).collect())) == want and len(want) > 20
    assert progress.totals["devices"]["late"] == 1 and progress.totals["devices"]["rows"] == 302 == progress.totals["devices"]["seen"]


def test_backfill_tries_failures_again(spark, tmp_path):
    done, tried = f"file://{tmp_path}/done", []
    pending = spark.createDataFrame([(k, k % 50) for k in range(25)], "id long, at int")

    def resolve(df):
        ids = sorted(r.id for r in df.select("id").collect())
        tried.append(ids)
        broken = [k for k in ids if k % 10 == 4 and len(tried) < 3]
        return df.withColumn("found", F.when(~F.col("id").isin(broken), F.concat(F.lit("place "), F.col("id").cast("string"))))

    progress = backfill.Progress()
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    q = backfill.backfill(ticks, lambda: pending, resolve, done, "id", "at", 10, f"file://{tmp_path}/check", progress).trigger(processingTime="200 milliseconds").start()
    seen, end = [], time.time() + 90
    while time.time() < end and progress.totals.get("backfill", {}).get("found", 0) < 25:
        seen.append(dict(progress.totals.get("backfill", {})))
        time.sleep(0.2)
    q.stop()
    got = spark.read.parquet(done)
    assert sorted(r.id for r in got.collect()) == list(range(25))
    assert tried[0] == list(range(15, 25)) and 24 in tried[1] and 24 in tried[2]
    assert all(a.get(k, 0) <= b.get(k, 0) for a, b in zip(seen, seen[1:], strict=False) for k in ("tried", "found", "failed"))


def test_a_tick_that_runs_again_writes_the_same(spark, tmp_path):
    done = f"file://{tmp_path}/done"
    pending = spark.createDataFrame([(k, k) for k in range(6)], "id long, at int")
    fine = lambda df: df.withColumn("found", F.lit("x"))
    for number in (0, 0, 1, 1):
        assert backfill.tick(number, pending, fine, done, "id", "at", 4)["tried"] == (4 if number == 0 else 2)
    assert sorted((r.id, r.batch) for r in spark.read.parquet(done).collect()) == [(0, 1), (1, 1), (2, 0), (3, 0), (4, 0), (5, 0)]
    nothing = backfill.tick(2, pending, fine, done, "id", "at", 4)
    assert nothing == {"tried": 0, "found": 0, "failed": 0}


def test_attempts_reach_the_state_in_packs(spark, monkeypatch):
    """One row for each key and task, not one for each attempt; packs are cut where they grow large."""
    batches = [pa.RecordBatch.from_pydict({"key": [k % 3 if k % 4 else None for k in range(a, a + 20)], "asked": list(range(a, a + 20)), "attempt": list(range(a, a + 20))}) for a in (0, 20, 40)]
    for most, rows in ((1 << 18, 4), (20, 12)):
        monkeypatch.setattr(claims, "PACK_ROWS", most)
        got = [r for b in claims.packs(iter(batches)) for r in b.to_pylist()]
        assert len(got) == rows
        assert sorted((str(r["key"]), a, t) for r in got for a, t in zip(r["asked"], r["attempt"], strict=True)) == sorted((str(k % 3 if k % 4 else None), k, k) for k in range(60))
    assert list(claims.packs(iter([]))) == []
