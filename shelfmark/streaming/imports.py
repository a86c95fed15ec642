"""Streaming import (T1, T4-T6): payload files to a versioned table of merged records.

Every micro-batch is parsed once and written to a staging folder named by its batch id, so a batch
that runs again after a failure replaces its own output. The fold into the record table runs when the
available input is staged: one rewrite of the table, however many micro-batches there were. This gives
the same rows as folding batch by batch, because a stored row carries the state of the fold. Lines arrive in the
order of release, file and place in the file, whichever micro-batch brought them.

Folders below ``base``: ``staged/release=R/batch=N`` (all parsed rows), ``records`` (a bucketed table), ``seen`` (a log of the
record references merged so far). A release rewrites the buckets its keys fall in and appends to the log. Records are
committed first, then the log: after a failure in between, the fold runs again and merges the same versions a second
time, which changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.discards import ABORT_RATE, check_error_rate
from shelfmark.operators.merge import HOT_ROWS
from shelfmark.operators.records import quality_score, with_derived
from shelfmark.operators.bucketed import BucketedTable, SeenLog
from shelfmark.operators.tables import VERSION_CONTENT, once_per_record, upsert_merge
from shelfmark.operators.workspace import Scratch
from shelfmark.sources.adapters import AdapterSettings, adapt
from shelfmark.sources.jsonl import arrival, read_line_stream


def _stage(
    batch: DataFrame, batch_id: int, base: str, collection: str, release_rank: int,
    settings: AdapterSettings, abort_rate: float,
) -> None:
    seq = arrival(release_rank, F.col("file"), F.col("block"))
    lines = batch.select(seq.alias("seq"), "line", "file")
    parsed = adapt(lines, collection, settings).withColumn("quality_score", quality_score())
    seen = Observation("import")
    is_ = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    parsed = parsed.observe(
        seen, F.count_if(F.col("part") == 0).alias("seen"), *[is_(o) for o in
        ("kept", "skipped", "discarded", "failed")],
    )
    target = f"{base}/staged/release={release_rank}/batch={batch_id}"
    parsed.write.mode("overwrite").parquet(target)
    spark = batch.sparkSession
    counters = spark.createDataFrame([seen.get]).coalesce(1)
    counters.write.mode("overwrite").parquet(
        f"{base}/counters/release={release_rank}/batch={batch_id}"
    )
    so_far = staged_counters(spark, base, release_rank).first()
    check_error_rate(so_far, abort_rate, final=False)


def stage_stream(
    spark: SparkSession,
    path: str,
    collection: str,
    base: str,
    release_rank: int = 1,
    max_files: int = 100,
    settings: AdapterSettings = AdapterSettings(),
    abort_rate: float = ABORT_RATE,
) -> StreamingQuery:
    """Stages all files that are there now and ends; stopping it between batches or a failure
    lose nothing, the next start continues from the checkpoint."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        _stage(batch, batch_id, base, collection, release_rank, settings, abort_rate)

    return (
        read_line_stream(spark, path, release_rank, max_files)
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", f"{base}/checkpoint/release={release_rank}")
        .trigger(availableNow=True)
        .start()
    )


def staged(spark: SparkSession, base: str, release_rank: int) -> DataFrame:
    return spark.read.parquet(f"{base}/staged/release={release_rank}/*")


def staged_counters(spark: SparkSession, base: str, release_rank: int) -> DataFrame:
    """Counters of a release over its micro-batches."""
    rows = spark.read.parquet(f"{base}/counters/release={release_rank}/*")
    return rows.agg(*[F.sum(c).alias(c) for c in ("seen", "kept", "skipped", "discarded", "failed")])


def record_table(spark: SparkSession, base: str) -> BucketedTable:
    return BucketedTable(spark, f"{base}/records")


def seen_log(spark: SparkSession, base: str) -> SeenLog:
    return SeenLog(spark, f"{base}/seen")


def current_records(spark: SparkSession, base: str) -> DataFrame | None:
    return record_table(spark, base).rows()


def fold_staged(
    spark: SparkSession,
    base: str,
    release_rank: int,
    abort_rate: float = ABORT_RATE,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """T5: the staged release merged into the record table as a new version.

    Versions merged before (same key and record reference) are left out first, so staging and folding
    the same payload again changes nothing.
    """
    check_error_rate(staged_counters(spark, base, release_rank).first(), abort_rate)
    records, seen = record_table(spark, base), seen_log(spark, base)
    with Scratch(spark) as tmp:
        kept = staged(spark, base, release_rank).filter(F.col("outcome") == "kept")
        rows = once_per_record(kept, content=VERSION_CONTENT)
        fresh = tmp.written(seen.unseen(rows), "fresh")

        def merge(stored: DataFrame, incoming: DataFrame) -> DataFrame:
            return with_derived(upsert_merge(stored, incoming, hot_rows=hot_rows), score=False)

        records.upsert(fresh, merge)
        seen.append(fresh)
    return records.rows()


def tidy(spark: SparkSession, base: str, keep: int = 2, most: int = 8) -> None:
    """Upkeep between imports: buckets of the log with more than ``most`` deltas are joined, and versions of both tables but the
    last ``keep`` go. It may be stopped and run again at any point; no fold may be at work."""
    seen_log(spark, base).compact(most)
    seen_log(spark, base).expire(keep)
    record_table(spark, base).expire(keep)
