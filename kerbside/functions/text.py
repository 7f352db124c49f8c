"""Folding, labels and keys of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to.
ACCENTED, PLAIN = "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"


def folded(x: Column) -> Column:
    """Lower case without accents; null as empty."""
    return F.translate(F.lower(F.coalesce(x, F.lit(""))), ACCENTED, PLAIN)


def contains_folded(term: str, *columns: Column) -> Column:
    """Whether any column contains the term, accents and case aside. The term is literal, not a pattern."""
    plain = term.lower().translate(str.maketrans(ACCENTED, PLAIN))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(folded(c), F.lit(plain))
    return hit


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def joined(separator: str, *columns: Column) -> Column:
    """The non-blank values with a separator between them; null for none."""
    return F.nullif(F.concat_ws(separator, *(blank_to_null(c) for c in columns)), F.lit(""))


def digits(x: Column) -> Column:
    """The number that a name's digits make."""
    return F.nullif(F.regexp_replace(x, "[^0-9]", ""), F.lit("")).cast("long")


def hash31(x: Column) -> Column:
    """Polynomial hash over code points, base 31, modulo 2**32."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(4294967296)))


def content_key(*parts: Column) -> Column:
    """SHA-256 over length-prefixed parts, so that no two lists of parts read alike."""
    whole = [F.concat(F.length(F.coalesce(p.cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p.cast("string"), F.lit(""))) for p in parts]
    return F.sha2(F.concat_ws("|", *whole), 256)


def code(x: Column, most: int = 32) -> tuple[Column, Column]:
    """A code in capitals without blanks about it (null for a blank one), and whether it is longer than allowed."""
    plain = F.upper(blank_to_null(x))
    return plain, F.coalesce(F.length(plain) > most, F.lit(False))


def numbered(prefix: str, n: Column, width: int, suffix: str = "") -> Column:
    """prefix, the number with zeros before it, suffix: names that sort by number."""
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"), F.lit(suffix))


def first_filled(*columns: Column) -> Column:
    """The first value that is not blank, as it is."""
    return F.coalesce(*(F.when(blank_to_null(c).isNotNull(), c) for c in columns))


def initials(name: Column) -> Column:
    """Capitals of the first two words."""
    words = F.slice(F.split(name, r"\s+"), 1, 2)
    return F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")


def place_id(lat: Column, lon: Column) -> Column:
    """A name that stays with a place: its coordinates to six digits."""
    return F.concat_ws("-", F.lit("f"), *(F.format_string("%.6f", c) for c in (lat, lon)))


def mask_digest(width: Column, height: Column, runs: Column) -> Column:
    """16 digits that tell masks apart: of their size and their runs' starts and lengths (an array of numbers)."""
    listed = F.array_join(F.transform(runs, lambda r: r.cast("string")), ",")
    return F.substring(F.sha2(F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit(":"), listed), 256), 1, 16)


def area_text(m2: Column) -> Column:
    """Hectares with two digits from 10,000 on, else whole square metres."""
    return F.when(m2 >= 10000, F.concat(F.format_string("%.2f", m2 / 10000), F.lit(" ha"))).otherwise(F.concat(F.floor(m2 + 0.5).cast("string"), F.lit(" m²")))


def distance_text(km: Column) -> Column:
    """Whole metres below a kilometre, else kilometres with one digit."""
    return F.when(km < 1, F.concat(F.floor(km * 1000 + 0.5).cast("string"), F.lit(" m"))).otherwise(F.concat(F.format_string("%.1f", km), F.lit(" km")))
