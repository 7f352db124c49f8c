"""Stops worth one trip: greedy groups along a road, folded in stretches at the same time.

In order of km, each free stop takes the first two free ones after it that lie within reach, on the map and
along the road. That order is a chain, but what a stretch of road hands to the next is little: the stops that
its last groups have taken there. So all stretches are folded at once, as if nothing came in; those whose
neighbour hands over something else than they were given are folded again, until nothing changes. Then
the groups are those of one fold over the whole road, by induction from its start. Mostly a few rounds do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.operators.stages import cut
from kerbside.session import ship_package

#: Reach on the map and along the road in km, partners, and the least level worth a trip.
REACH_KM, ALONG_KM, PARTNERS, LEAST_LEVEL = 1.5, 4.5, 2, 2
EARTH_KM = 6371.0
#: Km of road in a stretch; it must be ALONG_KM at least, so that groups reach into the next one only.
STRETCH_KM = 9.0


def apart_km(a: tuple[float, float], b: tuple[float, float]) -> float:
    (lat_a, lon_a), (lat_b, lon_b) = (tuple(map(math.radians, p)) for p in (a, b))
    h = math.sin((lat_b - lat_a) / 2) ** 2 + math.cos(lat_a) * math.cos(lat_b) * math.sin((lon_b - lon_a) / 2) ** 2
    return 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(h)))


def fold(stops: list[tuple[float, int, float, float]], anchors: int, taken: set[int]) -> Iterator[tuple[int, int, int, float]]:
    """Groups of sorted stops (km, id, lat, lon), of which the first `anchors` may start one: (anchor,
    member's place, id, km between)."""
    free = [s[1] not in taken for s in stops]
    for i in range(anchors):
        if not free[i]:
            continue
        found: list[tuple[int, float]] = []
        for j in range(i + 1, len(stops)):
            if len(found) == PARTNERS or stops[j][0] - stops[i][0] > ALONG_KM:
                break
            if free[j] and (d := apart_km(stops[i][2:], stops[j][2:])) <= REACH_KM:
                found.append((j, d))
        for k, (j, d) in enumerate([(i, 0.0), *found] if found else []):
            free[j] = False
            yield stops[i][1], k, stops[j][1], d


def candidates(stops: DataFrame, orders: DataFrame, key: str = "stop_id") -> DataFrame:
    """Stops of a level worth a trip that are in no order yet; orders have a row for each of their stops."""
    return stops.where(F.coalesce("level", F.lit(1)) >= LEAST_LEVEL).join(orders.select(key), key, "left_anti")


def groups(stops: DataFrame, by: str) -> DataFrame:
    """Members (by, anchor, place, stop_id, between_km) of the groups along each road; stops have stop_id,
    km, lat and lon. A stop without a place or km joins none; of equal km the lower stop_id comes first."""
    ship_package(stops.sparkSession)
    whole = F.col("km").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("stop_id").isNotNull()
    at = F.floor(F.col("km") / STRETCH_KM).cast("long")
    own = stops.where(whole).select(by, "stop_id", F.col("km").cast("double").alias("km"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), at.alias("stretch"), F.lit(False).alias("ahead"))
    ahead = own.where(F.col("km") - F.col("stretch") * STRETCH_KM <= ALONG_KM).withColumns({"stretch": F.col("stretch") - 1, "ahead": F.lit(True)})
    both = cut(own.unionByName(ahead))
    kind = stops.schema[by].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ahead", "km", "stop_id"])
        rows = list(zip(pdf["km"], pdf["stop_id"], pdf["lat"], pdf["lon"], strict=True))
        anchors = int((~pdf["ahead"]).sum())
        here = set(pdf["stop_id"][~pdf["ahead"]])
        found = list(fold(rows, anchors, set(pdf["stop_id"][pdf["taken"]])))
        out = pd.DataFrame(found, columns=["anchor", "place", "stop_id", "between_km"])
        return out.assign(**{by: pdf[by].iloc[0], "stretch": pdf["stretch"].iloc[0], "ahead": [i not in here for i in out["stop_id"]]})[[by, "stretch", "anchor", "place", "stop_id", "between_km", "ahead"]]

    def folded(rows: DataFrame) -> DataFrame:
        return rows.groupBy(by, "stretch").applyInPandas(one, f"{by} {kind}, stretch long, anchor long, place long, stop_id long, between_km double, ahead boolean")

    key = [by, "stretch"]
    given = both.select(*key, "stop_id").where("false")
    found = cut(folded(both.withColumn("taken", F.lit(False))))
    while True:
        handed = cut(found.where("ahead").select(by, (F.col("stretch") + 1).alias("stretch"), "stop_id"))
        other = cut(handed.exceptAll(given).unionByName(given.exceptAll(handed)).select(*key).distinct())
        if other.isEmpty():
            return found.drop("stretch", "ahead")
        again = both.join(other, key, "left_semi").join(handed.withColumn("taken", F.lit(True)), [*key, "stop_id"], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
        found, given = cut(found.join(other, key, "left_anti").unionByName(folded(again))), handed


def suggestions(members: DataFrame, stops: DataFrame, by: str) -> DataFrame:
    """A row for each group: its stops in order, levels, area, reach and kind, the most urgent and largest first."""
    told = members.join(stops.select(by, "stop_id", "km", "level", "area_m2", "equipment"), [by, "stop_id"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "stop_id"))), lambda m: m["stop_id"])
    out = told.groupBy(by, "anchor").agg(listed.alias("stops"), F.max("level").alias("level"), F.sum(F.coalesce("area_m2", F.lit(0.0))).alias("area_m2"), F.max("between_km").alias("between_km"), F.min_by("km", "place").alias("km"), (F.count_distinct(F.coalesce("equipment", F.lit(""))) == 1).alias("same_equipment"))
    return out.orderBy(F.desc("level"), F.desc("area_m2"), by, "anchor")
