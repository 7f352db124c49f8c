"""State changes as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same key, and the rest of new added."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def replace_groups(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """Every group that new holds is replaced as a whole."""
    return old.join(new.select(*group).distinct(), group, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], identity: list[str]) -> tuple[DataFrame, DataFrame]:
    """old with the absent rows added, and the rows whose key exists with another identity."""
    have = old.select(*keys, *(F.col(c).alias(f"_{c}") for c in identity))
    differs = [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in identity]
    conflict = new.join(have, keys).where(F.greatest(*(d.cast("int") for d in differs), F.lit(0)) == 1).select(*new.columns)
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns)), conflict


def patch(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """A change's null keeps the old value."""
    fields = [c for c in changes.columns if c not in keys]
    c = changes.select(*keys, *(F.col(f).alias(f"_{f}") for f in fields))
    return old.join(c, keys, "left").select(*(F.coalesce(f"_{f}", f).alias(f) if f in fields else f for f in old.columns))


def guarded(df: DataFrame, guard: Column, **values: Column) -> DataFrame:
    """Rows that meet the guard get the new values; `changed` says which did."""
    ok = F.coalesce(guard, F.lit(False))
    return df.withColumn("changed", ok).withColumns({c: F.when(F.col("changed"), v).otherwise(F.col(c)) for c, v in values.items()})


def status_events(history: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """A row for each change of status, the first status included."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(order))
    return history.withColumn("from_status", before).where(~F.col("from_status").eqNullSafe(F.col(status)))


def current_state(events: DataFrame, key: str, order: str, status: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(status, order).alias(status), F.count("*").alias("events"))


def expired(df: DataFrame, expires: str, as_of: Column) -> DataFrame:
    """What an expiry job leaves."""
    return df.where(F.col(expires).isNull() | (F.col(expires) >= as_of))


def merge_observations(local: DataFrame, remote: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each identity: a local one wins over a remote one, the later over the earlier."""
    both = local.withColumn("_side", F.lit(0)).unionByName(remote.withColumn("_side", F.lit(1)))
    first = Window.partitionBy(*keys).orderBy("_side", F.desc(order), *[c for c in local.columns if c not in keys and c != order])
    return both.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_side")


def monthly_reference(orders: DataFrame, created: str, tie: str, prefix: str) -> DataFrame:
    """prefix-yyyyMM-number, numbered within the month from 1001 on; numbers of five digits stay whole.

    Orders are numbered within their day, and each day goes on from the counts of the days before it.
    """
    day, month = F.to_date(created), F.date_format(created, "yyyyMM")
    before = Window.partitionBy(F.trunc("_day", "month")).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = orders.groupBy(day.alias("_day")).agg(F.count("*").alias("_n")).select("_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_day").orderBy(created, tie))
    numbered = orders.withColumn("_day", day).withColumn("_k", within).join(days, "_day", "left")
    return numbered.withColumn("reference", F.concat_ws("-", F.lit(prefix), month, (F.col("_k") + F.col("_before") + 1000).cast("string"))).select(*orders.columns, "reference")


def cascade_delete(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents without the keys in gone, and each child table (with its column of that key) without theirs."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    left = {n: df.join(ids, F.col(c) == F.col("_gone"), "left_anti") for n, (df, c) in children.items()}
    return parents.join(ids, F.col(key) == F.col("_gone"), "left_anti"), left
