"""Nearest-in-time joins by one sort: no row meets more than its two neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, keys: list[str], t: str, payload: list[str], tie: str, tolerance: int | None = None) -> DataFrame:
    """left with the payload of the nearest right row and its age.

    Of two rows equally far the earlier one counts, of one clock's rows the one of least `tie`. Beyond
    the tolerance the payload is null but the age stays. Both sides are laid into one sequence by key
    and time; the last right row before and the first after are found by windows.
    """
    first = right.groupBy(*keys, t).agg(F.min_by(F.struct(*payload), tie).alias("_p"))
    r = first.select(*keys, F.col(t).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(t).alias("t"), "_p").alias("_r"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_l"))
    l = left.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    order = Window.partitionBy(*keys).orderBy("_t", "_side")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    both = r.unionByName(l).withColumns({"_b": F.last("_r", ignorenulls=True).over(before), "_a": F.first("_r", ignorenulls=True).over(after)}).where("_side = 1")
    db, da = F.col("_t") - F.col("_b.t"), F.col("_a.t") - F.col("_t")
    early = F.col("_a").isNull() | (F.col("_b").isNotNull() & (db <= da))
    out = both.withColumns({"_n": F.when(early, F.col("_b")).otherwise(F.col("_a")), "age": F.when(early, db).otherwise(da)})
    near = F.lit(True) if tolerance is None else F.col("age") <= tolerance
    return out.select(*(F.col("_l")[c].alias(c) for c in left.columns), *(F.when(near, F.col("_n._p")[c]).alias(f"near_{c}" if c in left.columns else c) for c in payload), "age")
