"""The two kinds of median and percentile, and what is built on them. Non-finite values never count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: makes a median absolute deviation a standard deviation of normal errors.
NORMAL = 1.4826


def finite(x: Column) -> Column:
    """x, or null where it is not finite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def nearest_rank(x: str, p: float) -> Column:
    """The value at rank ceil(p n): always one of the values; of an even number the lower middle."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})")


def interpolated(x: str, p: float = 0.5) -> Column:
    """The interpolated percentile: of an even number the mean of the middle two."""
    return F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY {x})")


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.try_divide(part, whole)


def counted(condition: Column) -> Column:
    """Rows of a group that meet the condition: 0, not null, for none."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def rounded(x: Column, digits: int) -> Column:
    """x times a power of ten to the nearest whole number, halves away from 0, as SQL engines round doubles.

    Spark's round goes by a double's shortest decimals, so the two differ for values next to a half and for large ones.
    """
    size = F.abs(x) * 10.0**digits
    even = F.rint(size)  # halves to the even one; exact for doubles without a part after the point
    whole = F.when(size - even == 0.5, even + 1).otherwise(even)
    return F.when(finite(size).isNotNull(), F.signum(x) * whole / 10.0**digits).otherwise(x)
