"""Operational reports."""

from __future__ import annotations

import random
import uuid
from typing import NamedTuple

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.discards import effective_filters, share

PROJECTED_ROWS = 30_000_000


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    """A7."""
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def top_formats(records: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent formats of live rows, ties by name."""
    live = records.filter(~F.col("deleted"))
    named = live.groupBy(F.coalesce("extension", F.lit("-")).alias("format")).agg(
        F.count("*").alias("n")
    )
    return named.orderBy(F.desc("n"), "format").limit(n)


def table_profile(records: DataFrame) -> DataFrame:
    """One pass."""
    return records.agg(
        F.count("*").alias("records"),
        F.count_if("deleted").alias("tombstones"),
        F.count("work_key").alias("with_work_key"),
    )


def shares(
    records: DataFrame, names: DataFrame, column: str, table_bytes: Column | int
) -> DataFrame:
    """A10: rows per collection, share and proportional bytes; names without rows count 0.

    ``names(column)`` lists the active collections; others that have rows are shown as well (U3).
    """
    counts = counts_by(records, column)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    every = names.select(column).union(counts.select(column)).distinct()
    size = table_bytes if isinstance(table_bytes, Column) else F.lit(table_bytes)
    rows = every.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))
    part = share(F.col("n"), F.col("total"))
    return rows.withColumn("total", total.scalar()).select(
        column, "n", part.alias("share"), F.rint(size * part).cast("long").alias("bytes")
    )


def fixed_name_counts(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Rows per name of a fixed set, zero included, and the number of all rows scanned."""
    counts = counts_by(rows, column)
    scanned = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scanned"))
    wanted = names.select(column).distinct().join(counts, column, "left")
    return wanted.select(
        column, F.coalesce("n", F.lit(0)).alias("n"), scanned.scalar().alias("scanned")
    )


def bytes_per_row(records: DataFrame, columns: list[str], target: int = PROJECTED_ROWS) -> DataFrame:
    """Average text bytes of a row and the size at ``target`` rows."""
    size = F.lit(0).cast("long")
    for c in columns:
        size = size + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    sums = records.agg(F.count("*").alias("records"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    avg = share(F.col("bytes"), F.col("records"))
    return sums.select(
        "records", "bytes", avg.alias("bytes_per_row"), (avg * target).alias("projected_bytes")
    )


class Counted(NamedTuple):
    """A number of rows with the bounds of a 95 % interval; all three are the same when it is exact."""

    rows: int
    low: int
    high: int
    exact: bool


def counted_within(table: DataFrame, seconds: float, files: int = 32, seed: int = 0) -> Counted:
    """The rows of a stored Parquet table: exact when the count finishes in time, else estimated from a few of its files.

    A count without columns reads footers only. When the time is up its jobs are cancelled, and none is left running when the
    answer is there; the estimate counts so many files, drawn by ``seed``, and takes them for all.
    """
    spark = table.sparkSession
    context, group, found = spark.sparkContext, f"count-{uuid.uuid4().hex}", []

    def count() -> None:
        context.setJobGroup(group, "count within a time", interruptOnCancel=True)
        try:
            found.append(table.count())
        except Exception:  # cancelled; anything else shows again in the estimate
            pass

    counting = InheritableThread(target=count, session=spark)
    counting.start()
    counting.join(seconds)
    if counting.is_alive():
        context.cancelJobGroup(group)
        counting.join()
    if found:
        return Counted(found[0], found[0], found[0], True)
    every = sorted(table.inputFiles())
    drawn = random.Random(seed).sample(every, min(files, len(every)))
    if not drawn:
        raise TimeoutError("not counted in time, and no files to estimate from")
    counts = spark.read.parquet(*drawn).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("squares")).first()
    total, drawn_n = len(every), len(drawn)
    mean = sums["n"] / drawn_n  # a file without rows has no row here and counts as none
    variance = max(0.0, sums["squares"] / drawn_n - mean * mean) * drawn_n / max(1, drawn_n - 1)
    error = 1.96 * total * (variance / drawn_n * (1 - drawn_n / total)) ** 0.5
    rows = round(total * mean)
    return Counted(rows, max(sums["n"], round(rows - error)), round(rows + error), total == drawn_n)


def bucket_rates(buckets: DataFrame, releases: DataFrame, as_of: Column, hours: int = 12) -> DataFrame:
    """Records and bytes per second of the recent buckets; empty spans are left out."""
    recent = buckets.filter(F.col("bucket_start") >= as_of - F.expr(f"interval {hours} hours"))
    seconds = (F.unix_micros("last_at") - F.unix_micros("first_at")) / 1e6
    rows = recent.join(releases.select("release_id", "collection"), "release_id").withColumn(
        "sample_seconds", seconds
    )

    def rate(last: str, first: str) -> Column:
        return F.greatest((F.col(last) - F.col(first)) / F.col("sample_seconds"), F.lit(0.0))

    return rows.filter(F.col("sample_seconds") > 0).select(
        "release_id",
        "collection",
        "bucket_start",
        "sample_seconds",
        rate("last_records", "first_records").alias("records_per_second"),
        rate("last_bytes", "first_bytes").alias("bytes_per_second"),
    )


BLOCKED = "blocked_subcollection:"


def counted_filters(reason_rows: DataFrame) -> DataFrame:
    """Blocked rows per (release, name) as counted during imports: ``reason_rows`` has
    (release_id, release_identifier, discovered_at, reason, n)."""
    return reason_rows.filter(F.col("reason").startswith(BLOCKED)).select(
        "release_id",
        "release_identifier",
        "discovered_at",
        F.expr(f"substring(reason, {len(BLOCKED) + 1})").alias("subcollection"),
        "n",
    )


def recomputed_replaces(counted: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Counts of a reanalysed (release, name) replace those of its import."""
    keys = ["release_id", "subcollection"]
    rest = counted.join(recomputed.select(*keys), keys, "left_anti")
    return rest.unionByName(recomputed.select(*counted.columns))


def filter_impact(
    defaults: DataFrame,
    overrides: DataFrame,
    filtered: DataFrame,
    bytes_per_record: Column | float,
) -> DataFrame:
    """Every known filter name with its state, the rows it kept out of the newest release and
    of all releases, and what they would have cost."""
    state = effective_filters(defaults, overrides)
    at = F.struct("discovered_at", "release_identifier")
    seen = filtered.groupBy("subcollection").agg(
        F.max_by("n", at).alias("latest"), F.sum("n").alias("total")
    )
    size = bytes_per_record if isinstance(bytes_per_record, Column) else F.lit(bytes_per_record)
    blocked = F.coalesce("blocked", F.lit(False))
    cost = F.when(F.col("latest").isNull(), None).when(
        blocked, F.floor(F.col("latest") * size).cast("long")
    ).otherwise(F.lit(0).cast("long"))
    return state.join(seen, "subcollection", "full_outer").select(
        "subcollection",
        blocked.alias("blocked"),
        F.coalesce("is_default", F.lit(False)).alias("is_default"),
        F.coalesce("has_override", F.lit(False)).alias("has_override"),
        "latest",
        F.coalesce("total", F.lit(0)).alias("total"),
        cost.alias("extra_bytes"),
    )
