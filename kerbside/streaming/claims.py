"""Claims on keys as a stream: put if absent, taken over once they are stale.

The state of a key is who holds it and since when. It lives in the state store, so a stream that starts
again from its checkpoint neither loses a claim nor gives it twice; a delivery that comes again from the
holder is told the same as before.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kerbside.session import ship_package

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Attempts that are packed at once.
PACK_ROWS = 1 << 18
FATES = ("taken", "held", "expired", "released")


class Claims(StatefulProcessor):
    """Packs of attempts (asked, attempt) on a key, by the times they tell or, with `own_clock`, by when they arrive.

    By the own clock a claim that nobody takes over is given back by a timer once it is stale, and the
    state's time to live clears keys whose timer was lost with a deleted checkpoint.
    """

    def __init__(self, timeout: int, own_clock: bool, kind: str) -> None:
        self.timeout, self.own_clock, self.schema = timeout, own_clock, f"held long, holder {kind}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("claim", self.schema, 10 * self.timeout) if self.own_clock else handle.getValueState("claim", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        held, holder = self.state.get() or (None, None)
        now = timerValues.getCurrentProcessingTimeInMs() if self.own_clock else None
        changed = False
        tries, fates = sorted(t for r in rows for t in zip(r.asked, r.attempt, strict=True)), []
        for asked, attempt in tries:
            at = asked if now is None else now
            again = holder == attempt
            fate = "taken" if held is None or again else "expired" if at - held > self.timeout else "held"
            if fate != "held" and not again:
                held, holder, changed = at, attempt, True
            fates.append(fate)
        yield Row(key=key[0], asked=[a for a, _ in tries], attempt=[t for _, t in tries], fate=fates)
        if changed:
            self.state.update((held, holder))
            if self.own_clock:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(held + self.timeout + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        if self.state.exists():
            held, holder = self.state.get()
            self.state.clear()
            yield Row(key=key[0], asked=[held], attempt=[holder], fate=["released"])

    def close(self) -> None:
        pass


def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Attempts of one key in one row, among PACK_ROWS at a time: a row costs the processor far more than its attempts."""
    held, size = [], 0
    for batch in chain(batches, [None]):
        if batch is not None:
            held, size = [*held, batch], size + len(batch)
        if held and (batch is None or size >= PACK_ROWS):
            packed = pa.Table.from_batches(held).group_by("key", use_threads=False).aggregate([("asked", "list"), ("attempt", "list")])
            yield from packed.select(["key", "asked_list", "attempt_list"]).rename_columns(["key", "asked", "attempt"]).to_batches(max_chunksize=1024)
            held, size = [], 0


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need this store; set for the session unless it has it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def claims(attempts: DataFrame, key: str, asked: str, attempt: str, timeout: int, own_clock: bool = False) -> DataFrame:
    """A stream of (key, asked, attempt, fate: one of FATES) of attempts to claim a key (asked: a number; a null one claims nothing).

    By told times, attempts of a batch are taken in their order, and batches as they come. By the own clock
    `timeout` is in milliseconds.
    """
    spark = attempts.sparkSession
    ship_package(spark)
    use_state_store(spark)
    kind, own = (attempts.schema[c].dataType.simpleString() for c in (key, attempt))
    rows = attempts.where(F.col(asked).isNotNull()).select(F.col(key).alias("key"), F.col(asked).cast("long").alias("asked"), F.col(attempt).alias("attempt"))
    packed = rows.repartition("key").mapInArrow(packs, f"key {kind}, asked array<bigint>, attempt array<{own}>")
    told = packed.groupBy("key").transformWithState(Claims(timeout, own_clock, own), f"key {kind}, asked array<bigint>, attempt array<{own}>, fate array<string>", "append", "processingTime" if own_clock else "none")
    return told.select(F.col("key").alias(key), F.inline(F.arrays_zip("asked", "attempt", "fate")))
