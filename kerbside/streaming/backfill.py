"""Backfill on a timer, and counters that tell how far streams have come.

A tick takes the newest rows that still lack a result, tries them, and writes what it found under its own
number. What failed is simply still pending at the next tick; a tick that runs again after a lost driver
overwrites its own rows.
"""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener


def found_so_far(spark: SparkSession, schema, path: str) -> DataFrame:  # noqa: ANN001
    """Results of all ticks; none before the first."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def tick(number: int, pending: DataFrame, resolve: Callable[[DataFrame], DataFrame], done: str, key: str, newest: str, most: int) -> dict[str, int]:
    """Try the `most` newest rows without a result; resolve() adds `found`, null for a failure.

    Returns the counts of rows tried, found and failed.
    """
    spark = pending.sparkSession
    kind = f"{key} {pending.schema[key].dataType.simpleString()}, found string, batch long"
    known = found_so_far(spark, kind, done).where(F.col("batch") != number).select(key)
    tried = pending.join(known, key, "left_anti").orderBy(F.desc_nulls_last(newest), F.desc(key)).limit(most)
    counts = Observation()
    result = resolve(tried).select(key, "found").observe(counts, F.count(F.lit(1)).alias("tried"), F.count("found").alias("found"))
    result.where(F.col("found").isNotNull()).write.mode("overwrite").parquet(f"{done}/batch={number}")
    got = counts.get
    return {"tried": got["tried"], "found": got["found"], "failed": got["tried"] - got["found"]}


def backfill(ticks: DataFrame, pending: Callable[[], DataFrame], resolve: Callable[[DataFrame], DataFrame], done: str, key: str, newest: str, most: int, checkpoint: str, progress: Progress | None = None) -> DataStreamWriter:
    """A stream of ticks (as of the rate source, with a processing-time trigger) that each run one tick()."""

    def batch(_: DataFrame, number: int) -> None:
        counts = tick(number, pending(), resolve, done, key, newest, most)
        if progress is not None:
            progress.add("backfill", counts)

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


class Progress(StreamingQueryListener):
    """Running totals of streams, by query name: input rows, late rows, and what observe() counts. They never
    fall: a batch that is told again, with the number of one before, adds nothing."""

    def __init__(self) -> None:
        self.totals: dict[str, Counter[str]] = {}
        self.last: dict[str, int] = {}
        self.lock = threading.Lock()

    def add(self, name: str, counts: dict[str, int]) -> None:
        with self.lock:
            self.totals.setdefault(name, Counter()).update({k: max(0, int(v or 0)) for k, v in counts.items()})

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        name = p.name or str(p.id)
        with self.lock:
            if p.batchId <= self.last.get(name, -1):
                return
            self.last[name] = p.batchId
        observed = {k: v for row in p.observedMetrics.values() for k, v in row.asDict().items() if isinstance(v, int)}
        self.add(name, {"rows": p.numInputRows, "late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators), **observed})

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass
