"""Survey messages as a stream: each generation of a segment's window is worked on once.

Delivery is at least once; duplicates go by their identity, a failed message comes back until its budget
is used up and then lies in the poison table. Results are keyed by identity, so a batch that runs again
after a lost driver writes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: Attempts of a message before it is poison.
ATTEMPTS = 3
MESSAGE = "session_id long, segment_id long, window_index int, generation string, attempt int, sent_at timestamp, windows int"
IDENTITY = ["session_id", "segment_id", "window_index", "generation"]


def fate(failed: Column, attempt: Column) -> Column:
    return F.when(~failed, "done").when(attempt < ATTEMPTS, "retry").otherwise("poison")


def parse(raw: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Messages, and the payloads that are none."""
    parsed = raw.withColumn("m", F.from_json(F.col(column).cast("string"), MESSAGE))
    good = F.col("m.session_id").isNotNull() & F.col("m.segment_id").isNotNull() & F.col("m.generation").isNotNull()
    return parsed.where(good).select("m.*"), parsed.where(~F.coalesce(good, F.lit(False))).select(column)


def fan_out(messages: DataFrame) -> DataFrame:
    """A message for a whole segment becomes one for each of its windows."""
    each = F.when(F.col("window_index").isNotNull(), F.array("window_index")).otherwise(F.sequence(F.lit(0), F.greatest(F.coalesce("windows", F.lit(1)), F.lit(1)) - 1))
    return messages.withColumn("window_index", F.explode(each))


def once(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop further deliveries of one identity and attempt while the watermark remembers it."""
    return messages.withWatermark("sent_at", delay).dropDuplicatesWithinWatermark([*IDENTITY, "attempt"])


def read(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Messages as lines of JSON files that appear under path; the file bound is the back-pressure."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def process(messages: DataFrame, work: Callable[[DataFrame], DataFrame], done: str, retry: str, poison: str, checkpoint: str) -> DataStreamWriter:
    """work(batch) adds `failed`; results go to three Parquet tables, a folder for each batch, so that a
    batch that runs again overwrites its own."""

    def batch(df: DataFrame, number: int) -> None:
        worked = work(df).withColumn("fate", fate(F.coalesce("failed", F.lit(True)), F.col("attempt"))).persist()
        for name, path in (("done", done), ("retry", retry), ("poison", poison)):
            worked.where(F.col("fate") == name).withColumn("attempt", F.col("attempt") + F.lit(int(name == "retry"))).drop("fate").write.mode("overwrite").parquet(f"{path}/batch={number}")
        worked.unpersist()

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
