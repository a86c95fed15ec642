"""Small field cleaners: extension, year, series position, authors."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import collapse_spaces, strip

# Accepted file extensions, year and series ranges, author separators.
EXTENSION_SHAPE = r"^[a-z0-9]{1,10}$"
YEAR_MIN, YEAR_MAX = 1000, 2100
SERIES_MIN, SERIES_MAX = 1, 32767
AUTHOR_SEPARATORS = r"(?U)\s*[;|]\s*|\s+,\s*|\s*&\s*|\s+\band\b\s+"
AUTHOR_EDGES = " ,;"


def _decimal_digits() -> tuple[str, str]:
    """Non-ASCII decimal digits and the ASCII digit of each."""
    pairs = [
        (chr(cp), str(int(chr(cp))))
        for cp in range(128, sys.maxunicode + 1)
        if chr(cp).isdecimal()
    ]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_DIGITS_FROM, _DIGITS_TO = _decimal_digits()


def normalize_extension(c: Column) -> Column:
    """X9."""
    ext = F.regexp_replace(F.lower(strip(c)), r"^\.+", "")
    return F.when(ext.rlike(EXTENSION_SHAPE), ext)


def normalize_year(c: Column) -> Column:
    """The first run of four digits, if it is a plausible year."""
    run = F.regexp_extract(c, r"(\p{Nd}{4})", 1)
    year = F.translate(run, _DIGITS_FROM, _DIGITS_TO).try_cast("short")
    return F.when(year.between(YEAR_MIN, YEAR_MAX), year)


def normalize_series_position(c: Column) -> Column:
    """X11."""
    pos = strip(c.cast("string")).try_cast("int")
    return F.when(pos.between(SERIES_MIN, SERIES_MAX), pos.cast("short"))


def split_authors(c: Column) -> Column:
    """Author list of one string; a plain comma does not split."""
    parts = F.split(strip(c), AUTHOR_SEPARATORS)
    names = F.transform(parts, lambda x: F.btrim(collapse_spaces(x), F.lit(AUTHOR_EDGES)))
    return F.coalesce(F.filter(names, lambda x: x != ""), F.array().cast("array<string>"))
