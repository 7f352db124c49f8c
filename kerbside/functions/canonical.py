"""One text for equal JSON: keys in order, no blanks, each number in its shortest form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside.functions.vectors import let

#: Strings, numbers, and whatever else JSON is made of.
TOKENS = r'"(?:[^"\\]|\\.)*"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[\[\]{},:]|true|false|null'
#: Numbers below 1e-6 and from 1e21 on are written with an exponent.
LEAST_PLACES, MOST_PLACES = -6, 21


def short_number(x: Column) -> Column:
    """A finite number's text: the fewest digits that tell it apart, as scripts in browsers write it; 0 for -0.

    Java before 19 writes some numbers with digits too many, so those of 16 and more are tried with fewer;
    below 2.3e-308 its digits stand.
    """
    return let(_fewest(F.abs(x)), lambda text: _placed(x, text))


def _fewest(size: Column) -> Column:
    """d.d or d.de+-d of a number that is not below 0."""
    own = size.cast("string")
    digits = F.length(F.regexp_replace(F.regexp_replace(own, "E.*$", ""), "[^0-9]|^0\\.0*", ""))
    some, more = (F.format_string(f"%.{n}e", size) for n in (14, 15))
    return F.when(digits <= 15, own).when(some.cast("double") == size, some).when(more.cast("double") == size, more).otherwise(own)


def _placed(x: Column, text: Column) -> Column:
    whole, part = F.regexp_extract(text, r"^(\d+)\.", 1), F.regexp_replace(F.regexp_extract(text, r"\.(\d+)", 1), "0+$", "")
    power = F.coalesce(F.nullif(F.regexp_extract(text, r"[eE]([+-]?\d+)$", 1), F.lit("")), F.lit("0")).cast("int")

    def placed(v: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(v["all"], "^0+", ""), "0+$", "")
        point = v["point"] - (F.length(v["all"]) - F.length(F.regexp_replace(v["all"], "^0+", "")))
        return let(F.struct(digits.alias("d"), point.alias("n")), written)

    def written(v: Column) -> Column:
        d, n, k = v["d"], v["n"], F.length(v["d"])
        shift = n - 1
        tail = F.concat(F.lit("e"), F.when(shift < 0, "-").otherwise("+"), F.abs(shift).cast("string"))
        return (
            F.when((k <= n) & (n <= MOST_PLACES), F.concat(d, F.repeat(F.lit("0"), F.greatest(n - k, F.lit(0)))))
            .when((n > 0) & (n <= MOST_PLACES), F.concat(d.substr(F.lit(1), n), F.lit("."), d.substr(n + 1, k)))
            .when((n > LEAST_PLACES) & (n <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-n, F.lit(0))), d))
            .when(k == 1, F.concat(d, tail))
            .otherwise(F.concat(d.substr(F.lit(1), F.lit(1)), F.lit("."), d.substr(F.lit(2), k), tail))
        )

    plain = let(F.struct(F.concat(whole, part).alias("all"), (F.length(whole) + power).alias("point")), placed)
    return F.when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), plain))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))


def _is_number(token: Column) -> Column:
    return token.rlike("^-?[0-9]")


def canonical_json(text: Column) -> Column:
    """The canonical text of a JSON text; null for what is none, has a key twice, or a number beyond a double.

    Keys are sorted by their UTF-8 bytes at every depth (VARIANT keeps them so); numbers are taken as doubles.
    """
    sound = ~F.exists(_tokens(text), lambda t: F.coalesce(_is_number(t) & (F.abs(t.try_cast("double")) == float("inf")), F.lit(False)))
    sorted_text = F.to_json(F.try_parse_json(text))
    short = F.transform(_tokens(sorted_text), lambda t: F.when(_is_number(t), let(t.try_cast("double"), short_number)).otherwise(t))
    return F.when(sound & sorted_text.isNotNull(), F.array_join(short, ""))
