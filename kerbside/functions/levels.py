"""Levels, qualities and labels of readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fewest measured cells of a level, and the heights where levels 2 and 3 begin.
LEAST_CELLS, MIDDLE_M, TALL_M = 20, 0.10, 0.30
#: Horizontal accuracy in metres up to which a fix is good, or degraded.
GOOD_M, DEGRADED_M = 10.0, 25.0


def level(height: Column, cells: Column) -> Column:
    """1 to 3; null where the height is unknown or too few cells stand behind it. Unknown is not low."""
    unknown = height.isNull() | F.isnan(height) | (F.coalesce(cells, F.lit(0)) < LEAST_CELLS)
    return F.when(unknown, None).when(height > TALL_M, 3).when(height >= MIDDLE_M, 2).otherwise(1)


def bucket(level_column: Column) -> Column:
    """The level, 0 for anything that is not 1, 2 or 3."""
    return F.when(level_column.isin(1, 2, 3), level_column).otherwise(0)


def has_level(level_column: Column, wanted: int | None) -> Column:
    """Whether a reading is in the bucket; anything for None."""
    if wanted is None:
        return F.lit(True)
    return (level_column.isNull() | ~level_column.isin(1, 2, 3)) if wanted == 0 else F.coalesce(level_column == wanted, F.lit(False))


def fix_quality(accuracy_m: Column) -> Column:
    return F.when(accuracy_m <= GOOD_M, "good").when(accuracy_m <= DEGRADED_M, "degraded").otherwise("unavailable")


def worst_quality(quality: Column) -> Column:
    """Of a group."""
    rank = F.when(quality == "good", 2).when(quality == "degraded", 1).otherwise(0)
    return F.element_at(F.array(F.lit("unavailable"), F.lit("degraded"), F.lit("good")), F.min(rank) + 1)


def equipment(level_column: Column) -> Column:
    return F.when(level_column == 3, "tractor").when(level_column == 2, "brush cutter").when(level_column == 1, "none")
