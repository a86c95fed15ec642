"""Counter maps and time helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_counters(left: Column, right: Column) -> Column:
    """Key-wise sum of two maps, a missing key counts as 0."""
    return F.map_zip_with(
        left, right, lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    )


def overlay(left: Column, right: Column) -> Column:
    """Keys of both maps, the right value wins."""
    return F.map_zip_with(left, right, lambda k, a, b: F.coalesce(b, a))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end."""
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def clock_text(ts: Column) -> Column:
    """X27."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def five_minutes(ts: Column) -> Column:
    """Start of the five-minute bin of a time."""
    return F.window(ts, "5 minutes")["start"]
