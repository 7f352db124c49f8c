"""Forms of text, days and sizes on single values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kerbside.functions import dates, geo, text, vectors
from kerbside.operators import sampling


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


def test_text(spark):
    lit = F.lit
    code, long = text.code(lit("  sp-021 "), 5)
    assert one(spark, code, long, *text.code(lit(" "))) == ("SP-021", True, None, False)
    assert one(spark, text.numbered("w", lit(7), 2), text.first_filled(lit(None).cast("string"), lit("  "), lit(" a ")), text.first_filled(lit(""))) == ("w07", " a ", None)
    assert one(spark, text.initials(lit("ana maria braga")), text.initials(lit("x")), text.initials(lit(""))) == ("AM", "X", "")
    assert one(spark, text.place_id(lit(-23.5), lit(0.1234565))) == ("f--23.500000-0.123457",)
    assert one(spark, *(text.area_text(lit(v)) for v in (0.5, 9999.4, 10000.0, 123456.0))) == ("1 m²", "9999 m²", "1.00 ha", "12.35 ha")
    assert one(spark, *(text.distance_text(lit(v)) for v in (0.0004, 0.9996, 1.0, 12.34))) == ("0 m", "1000 m", "1.0 km", "12.3 km")
    a, b = one(spark, text.mask_digest(lit(2), lit(3), F.array(lit(1), lit(2))), text.mask_digest(lit(23), lit(3), F.array(lit(1), lit(2))))
    assert a != b and len(a) == 16


def test_days_of_a_zone(spark):
    at = F.lit(dt.datetime(2024, 3, 3, 1, 30, tzinfo=dt.timezone.utc))  # still Saturday evening in Sao Paulo
    zone = "America/Sao_Paulo"
    assert one(spark, dates.day_key(at), dates.day_key(at, zone), dates.week_start(at, zone), dates.month_key(at)) == ("2024-03-03", "2024-03-02", dt.date(2024, 2, 26), "202403")
    begin, end = (F.unix_seconds(c) for c in dates.day_bounds(F.lit("2024-03-02"), F.lit("2024-03-02"), zone))
    assert one(spark, end - begin, begin) == (86400, int(dt.datetime(2024, 3, 2, 3, tzinfo=dt.timezone.utc).timestamp()))
    assert one(spark, *(c.isNull() for c in dates.day_bounds(F.lit(None).cast("string"), F.lit(None).cast("string")))) == (True, True)
    assert one(spark, F.unix_micros(dates.instant_after(at, F.lit(1999))) - F.unix_micros(at)) == (1,)


def test_sizes_and_directions(spark):
    lit = F.lit
    assert one(spark, *geo.scaled_size(lit(1920), lit(1080), 504), *geo.scaled_size(lit(300), lit(5), 504), *geo.scaled_size(lit(5000), lit(3), 504), *geo.scaled_size(lit(900), lit(7), 0)) == (504, 284, 300, 5, 504, 2, 900, 7)
    assert one(spark, *(geo.cardinal(lit(v)) for v in (0.0, 44.9, 45.0, 135.0, 225.0, 314.9, 315.0))) == ("north", "north", "east", "south", "west", "west", "north")
    assert one(spark, sampling.even_numbers(lit(0)), sampling.even_numbers(lit(1)), sampling.even_numbers(lit(3)), sampling.even_numbers(lit(4), 3)) == ([], [1], [1, 129, 256], [1, 2, 3, 4])
    m = F.array(*(lit(float(v)) for v in (0, -3, 0, 9, 3, 0, 0, 9, 0, 0, 3, 9, 0, 0, 0, 1)))
    up, none = one(spark, vectors.turned(m, vectors.vector(lit(2), lit(0), lit(0))), vectors.turned(m, vectors.vector(lit(0), lit(0), lit(0))))
    assert tuple(up) == pytest.approx((0, 1, 0)) and none is None
