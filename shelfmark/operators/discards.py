"""Discard filters, counters and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLES = 3
ERROR_SAMPLES = 20
ABORT_RATE = 0.02
CHECK_AFTER = 10_000


def effective_filters(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """(subcollection, blocked, is_default, has_override) of ``defaults(subcollection)`` overlaid
    by ``overrides(subcollection, blocked)``."""
    d = defaults.select("subcollection").distinct().withColumn("_d", F.lit(True))
    o = overrides.select("subcollection", F.col("blocked").alias("_o"))
    return d.join(o, "subcollection", "full_outer").select(
        "subcollection",
        F.coalesce("_o", F.lit(True)).alias("blocked"),
        F.col("_d").isNotNull().alias("is_default"),
        F.col("_o").isNotNull().alias("has_override"),
    )


def with_block_reason(rows: DataFrame, group: str, filters: DataFrame) -> DataFrame:
    """``discard_reason`` of rows whose group is blocked by a filter table."""
    blocked = filters.filter("blocked").select(F.col("subcollection").alias(group))
    marked = rows.join(blocked.withColumn("_b", F.lit(True)), group, "left")
    reason = F.when(F.col("_b"), F.concat(F.lit("blocked_subcollection:"), F.col(group)))
    return marked.withColumn("discard_reason", reason).drop("_b")


def import_counters(parsed: DataFrame) -> DataFrame:
    """A4: one row of counters over adapter output."""
    is_ = lambda o: F.col("outcome") == o
    return parsed.agg(
        F.count_if(F.col("part") == 0).alias("seen"),
        F.count_if(is_("kept")).alias("kept"),
        F.count_if(is_("skipped")).alias("skipped"),
        F.count_if(is_("discarded")).alias("discarded"),
        F.count_if(is_("failed")).alias("failed"),
    )


def discard_counts(rows: DataFrame) -> DataFrame:
    """A5."""
    reason = F.coalesce("discard_reason", F.lit("unspecified"))
    return rows.groupBy(reason.alias("discard_reason")).agg(F.count("*").alias("n"))


def first_distinct(
    rows: DataFrame, group: str, order: str, sample: list[str], limit: int = SAMPLES
) -> DataFrame:
    """The first ``limit`` distinct samples of each group in ``order``, with ``place``.

    Copies are reduced to their first arrival map-side; the row-number limit keeps only the best few
    rows of a group per task before the shuffle, so a group of any size costs a few rows.
    """
    firsts = rows.groupBy(group, *sample).agg(F.min(order).alias(order))
    place = F.row_number().over(W.partitionBy(group).orderBy(order, *sample))
    return firsts.withColumn("place", place).filter(F.col("place") <= limit)


def discard_samples(discarded: DataFrame, limit: int = SAMPLES) -> DataFrame:
    """Representative discarded records per reason: title to 160 characters, 3 authors."""
    shown = discarded.select(
        F.coalesce("discard_reason", F.lit("unspecified")).alias("discard_reason"),
        "seq",
        "md5",
        "source_record_id",
        "aacid",
        F.nullif(F.substring("title", 1, 160), F.lit("")).alias("title"),
        F.slice("authors", 1, 3).alias("authors"),
    )
    fields = ["md5", "source_record_id", "aacid", "title", "authors"]
    return first_distinct(shown, "discard_reason", "seq", fields, limit)


def samples_over_releases(samples: DataFrame, limit: int = SAMPLES, releases: int = 20) -> DataFrame:
    """A6 over the newest releases: ``samples`` has (release_id, discovered_at, discard_reason, place,
    sample); newest releases come first."""
    newest = (
        samples.select("release_id", "discovered_at")
        .distinct()
        .orderBy(F.desc("discovered_at"), F.desc("release_id"))
        .limit(releases)
    )
    rank = F.struct((-F.unix_micros("discovered_at")).alias("t"), (-F.col("release_id")).alias("r"), "place")
    rows = samples.join(F.broadcast(newest.select("release_id")), "release_id", "left_semi")
    ordered = rows.select("discard_reason", "sample", rank.alias("at"))
    return first_distinct(ordered, "discard_reason", "at", ["sample"], limit).drop("at")


def error_samples(parsed: DataFrame, limit: int = ERROR_SAMPLES) -> DataFrame:
    """The first failed lines."""
    return parsed.filter(F.col("error").isNotNull()).orderBy("seq").limit(limit).select("seq", "error")


def check_error_rate(counters: Row, abort_rate: float = ABORT_RATE, final: bool = True) -> None:
    """Raises when too many lines failed; at the end also when there were none at all.

    Before the end the rate only counts once enough lines were seen.
    """
    seen, failed = counters["seen"], counters["failed"]
    if final and seen == 0:
        raise RuntimeError("the payload holds no records")
    if (final or seen >= CHECK_AFTER) and failed > abort_rate * seen:
        raise RuntimeError(f"{failed} of {seen} lines failed, more than {abort_rate:.2%}")


def quarantine(parsed: DataFrame, path: str) -> None:
    """Rejected rows by reason."""
    reason = F.coalesce("discard_reason", "outcome")
    rejected = parsed.filter(F.col("outcome").isin("failed", "discarded"))
    # the file names of Hive-style partitions must not hold a colon
    rejected.withColumn("reason", F.translate(reason, ":/", "__")).write.mode("overwrite").partitionBy(
        "reason"
    ).parquet(path)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
