"""Who may work on a window: claims that run out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def claims(attempts: DataFrame, keys: list[str], at: str, order: str, timeout: int) -> DataFrame:
    """The fate of every attempt (at: a number) to claim a key: taken, held elsewhere, or expired and taken over.

    A claim holds until more than `timeout` has passed. Attempts on one key are the deliveries of one
    message, some few, so they travel as an array; ties go by `order`. A null time claims nothing.
    """
    listed = F.array_sort(F.collect_list(F.when(F.col(at).isNotNull(), F.struct(F.col(at).cast("long").alias("t"), F.col(order).alias("o")))))
    kinds = {f.name: f.dataType.simpleString() for f in attempts.schema}
    start = F.struct(F.lit(None).cast("long").alias("held"), F.array().cast(f"array<struct<t: bigint, o: {kinds[order]}, fate: string>>").alias("out"))

    def step(acc: Column, a: Column) -> Column:
        fate = F.when(acc["held"].isNull(), "taken").when(a["t"] - acc["held"] > timeout, "expired").otherwise("held")
        return F.struct(F.when(fate == "held", acc["held"]).otherwise(a["t"]).alias("held"), F.concat(acc["out"], F.array(F.struct(a["t"].alias("t"), a["o"].alias("o"), fate.alias("fate")))).alias("out"))

    told = attempts.groupBy(*keys).agg(F.aggregate(listed, start, step)["out"].alias("_out"))
    return told.select(*keys, F.explode("_out").alias("_a")).select(*keys, F.col("_a.t").alias(at), F.col("_a.o").alias(order), F.col("_a.fate").alias("fate"))
