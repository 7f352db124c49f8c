"""What every list asks for: optional filters, a total order, a page with its total, and validity splits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.levels import bucket
from kerbside.functions.text import folded

#: Default and greatest page sizes.
LIMITS = {"readings": (25, 1000), "sessions": (50, 200), "segments": (25, 200), "orders": (50, 200)}
#: Orders of sessions; every one ends with the session's id.
SESSION_ORDERS: dict[str, list[tuple[str, str]]] = {
    "STARTED_DESC": [("started_at", "desc_nulls_last")],
    "STARTED_ASC": [("started_at", "asc_nulls_last")],
    "CRITICAL_DESC": [("l3", "desc"), ("l2", "desc"), ("started_at", "desc_nulls_last")],
}
#: What a filter's value asks of a row, by the filter's name.
FILTERS: dict[str, Callable[[object], Column]] = {
    "level": lambda v: bucket(F.col("level")) == v,
    "road": lambda v: F.col("road") == v,
    "direction": lambda v: F.lower("direction") == str(v).lower(),
    "since": lambda v: F.col("captured_at") >= F.lit(v),
    "until": lambda v: F.col("captured_at") < F.lit(v),
    "search": lambda v: F.contains(folded(F.col("place")), folded(F.lit(v))),
    "notes": lambda v: F.contains(F.lower("notes"), F.lower(F.lit(v))),
    "reference": lambda v: F.startswith(F.col("reference"), F.lit(v)),
    "status": lambda v: F.col("status") == v,
}


def asked(value: object) -> object:
    """A value as it counts: blank texts and levels that do not exist ask nothing."""
    if isinstance(value, str):
        return value.strip() or None
    return value


def where_asked(df: DataFrame, **values: object) -> DataFrame:
    """The rows that all given filters take; None, a blank and a level outside 0..3 ask nothing."""
    found = {k: v for k, value in values.items() if (v := asked(value)) is not None and not (k == "level" and v not in range(4))}
    return df.where(reduce(Column.__and__, (FILTERS[k](v) for k, v in found.items()), F.lit(True)))


def page(df: DataFrame, kind: str, order: list[Column], limit: int = 0, offset: int = 0) -> DataFrame:
    """A page of rows, each with the total of the filtered set and whether more rows follow the page."""
    default, most = LIMITS[kind]
    size, start = (default if limit <= 0 else min(limit, most)), max(offset, 0)
    total = df.agg(F.count("*").alias("total"))
    # The total is one row, so this join only adds a constant.
    rows = df.orderBy(*order).offset(start).limit(size).crossJoin(F.broadcast(total))
    return rows.withColumn("has_more", F.col("total") > start + size)


def session_order(name: str) -> list[Column]:
    chosen = SESSION_ORDERS.get(name, SESSION_ORDERS["STARTED_DESC"])
    return [*(getattr(F.col(c), d)() for c, d in chosen), F.desc("session_id")]


def first_fault(**faults: Column) -> Column:
    """The name of the first fault that a row has, null for a sound one; an unknown answer is a fault."""
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in faults.items()))


def fix_fault() -> Column:
    """Why a position fix is not usable."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return first_fault(
        clock=F.col("t") < 0,
        position=~(finite("lat") & finite("lon")),
        latitude=F.abs("lat") > 90,
        longitude=F.abs("lon") > 180,
        accuracy=~finite("accuracy") | (F.col("accuracy") < 0),
        speed=F.col("speed").isNotNull() & ~(finite("speed") & (F.col("speed") >= 0)),
    )


def request_fault(most_ms: int = 30_000) -> Column:
    """Why an extraction request is not taken."""
    return first_fault(
        checksum=~F.rlike("checksum", F.lit("^[0-9a-f]{64}$")),
        duration=(F.col("duration_ms") <= 0) | (F.col("duration_ms") > most_ms),
        index=F.col("segment_index") < 0,
        key=F.length(F.trim("object_key")) == 0,
    )


def generation_conflicts(stored: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """Requests whose key is stored already under another checksum."""
    both = requested.join(stored.withColumnRenamed("checksum", "stored_checksum"), key)
    return both.where(F.col("checksum") != F.col("stored_checksum")).select(key, "stored_checksum", "checksum")


def backfill(df: DataFrame, pending: Column, newest: str, key: str, most: int) -> DataFrame:
    """The newest pending rows, `most` of them."""
    return df.where(pending).orderBy(F.desc_nulls_last(newest), F.desc(key)).limit(most)


#: States of a segment, and where an event takes it from each.
TRANSITIONS = [
    ("awaiting_upload", "upload_started", "uploading"),
    ("uploading", "upload_done", "queued"),
    ("queued", "taken", "validating"),
    ("validating", "passed", "ready"),
    ("validating", "refused", "failed"),
    ("failed", "retried", "queued"),
]


def apply_events(df: DataFrame) -> DataFrame:
    """Rows with state and event: the state after it, and whether the event was allowed there."""
    allowed = F.create_map(*(F.lit(x) for a, e, b in TRANSITIONS for x in (f"{a}/{e}", b)))
    after = F.element_at(allowed, F.concat_ws("/", "state", "event"))
    return df.withColumns({"allowed": after.isNotNull(), "after": F.coalesce(after, "state")})


def distinct_in_order(df: DataFrame, keys: list[str], group: str, order: str) -> DataFrame:
    """Each group's different targets with the place at which each came first, counted from 0."""
    from pyspark.sql import Window

    first = df.groupBy(group, *keys).agg(F.min(order).alias("_first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_first")) - 1).drop("_first")


def target_faults(targets: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Targets that are missing or not measured; known has the keys and measured_at."""
    found = targets.join(known.select(*keys, "measured_at", F.lit(True).alias("_known")), keys, "left")
    fault = F.when(F.col("_known").isNull(), "missing").when(F.col("measured_at").isNull(), "unmeasured")
    return found.withColumn("fault", fault).where(F.col("fault").isNotNull()).drop("_known", "measured_at")


def order_features(df: DataFrame, group: str) -> DataFrame:
    """An order from its features: area, the highest level, and the equipment that the levels need, once each."""
    equipment = F.array_sort(F.collect_set("equipment"))
    return df.groupBy(group).agg(F.sum("area").alias("area"), F.max("level").alias("level"), F.array_join(equipment, ", ").alias("equipment"))
