"""Facts about videos from the JSON that a media probe prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STREAM = "struct<width: int, height: int, avg_frame_rate: string, tags: struct<rotate: string>, side_data_list: array<struct<rotation: int>>>"
PROBE = f"streams array<{STREAM}>, format struct<duration: string>"
FRAMES = "frames array<struct<best_effort_timestamp_time: string, key_frame: int>>"


def rate(text: Column) -> Column:
    """Frames a second of a fraction; 0 where it is none or its lower part is not positive."""
    parts = F.split(text, "/", 2)
    up, low = (F.try_element_at(parts, F.lit(k)).try_cast("double") for k in (1, 2))
    return F.coalesce(F.when(low > 0, up / low), F.lit(0.0))


def media_facts(probes: DataFrame, keys: list[str], json: str) -> DataFrame:
    """Duration, rate, rotation in [0, 360) and size as shown, of each probe's first stream; else its fault.

    A quarter turn swaps the axes. Text that is no probe has no stream.
    """
    p = probes.select(*keys, F.from_json(json, PROBE).alias("_p"))
    s = F.try_element_at(F.col("_p.streams"), F.lit(1))
    turned = F.try_element_at(F.filter(s["side_data_list"], lambda x: x["rotation"].isNotNull()), F.lit(1))["rotation"]
    turn = F.pmod(F.coalesce(turned, s["tags"]["rotate"].try_cast("int"), F.lit(0)), F.lit(360))
    p = p.select(*keys, s.isNull().alias("_none"), F.col("_p.format.duration").try_cast("double").alias("_d"), rate(s["avg_frame_rate"]).alias("_r"), turn.alias("_t"), s["width"].alias("_w"), s["height"].alias("_h"))
    sound = (F.col("_d") > 0) & ~F.isnan("_d") & (F.col("_d") < float("inf")) & (F.col("_w") > 0) & (F.col("_h") > 0)
    fault = F.when(F.col("_none"), "no stream").when(~F.coalesce(sound, F.lit(False)), "no duration or size")
    swap = F.col("_t") % 180 == 90
    facts = {"duration_s": F.col("_d"), "rate": F.col("_r"), "rotation": F.col("_t"), "width": F.when(swap, F.col("_h")).otherwise(F.col("_w")), "height": F.when(swap, F.col("_w")).otherwise(F.col("_h"))}
    return p.select(*keys, fault.alias("fault"), *(F.when(fault.isNull(), v).alias(n) for n, v in facts.items()))


def frame_timeline(probes: DataFrame, keys: list[str], json: str) -> DataFrame:
    """Each frame's place, nanoseconds after the first frame, and whether it is a key frame.

    A probe without frames gives one row with its fault; one with a time that is no number, or that runs
    backwards or begins below zero, gives its frames with the fault and without times.
    """
    f = probes.select(*keys, F.posexplode_outer(F.from_json(json, FRAMES)["frames"]).alias("frame", "_f"))
    f = f.select(*keys, "frame", F.round(F.col("_f.best_effort_timestamp_time").try_cast("decimal(20,10)") * 1000000000).cast("long").alias("_t"), F.coalesce(F.col("_f.key_frame") == 1, F.lit(False)).alias("key_frame"))
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("frame")
    f = f.withColumn("_back", F.col("_t") < F.coalesce(F.lag("_t").over(order), F.lit(0)))
    fault = F.when(F.col("frame").isNull(), "no frames").when(F.max(F.col("_t").isNull()).over(whole), "invalid time").when(F.max(F.coalesce("_back", F.lit(False))).over(whole), "time runs backwards")
    f = f.withColumns({"fault": fault, "_first": F.first("_t").over(order)})
    return f.select(*keys, "frame", F.when(F.col("fault").isNull(), F.col("_t") - F.col("_first")).alias("at_ns"), "key_frame", "fault")
