"""Five-minute throughput buckets (T2, T3, X25) and repeat suppression in streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WATERMARK = "10 minutes"
BUCKET = "5 minutes"


def performance_buckets(samples: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """First and last sample of each (release, bucket); ``samples`` has (release_id, ts,
    records_seen, bytes). The same function serves batch and stream; on a stream the watermark bounds
    the state."""
    if samples.isStreaming:
        samples = samples.withWatermark("ts", watermark)
    # samples of one moment are ordered by their counters, so the result does not depend on the
    # order of arrival
    at = F.struct("ts", "records_seen", "bytes")
    grouped = samples.groupBy("release_id", F.window("ts", BUCKET).alias("w")).agg(
        F.min(at).alias("a"), F.max(at).alias("z")
    )
    return grouped.select(
        "release_id",
        F.col("w.start").alias("bucket_start"),
        F.col("a.ts").alias("first_at"),
        F.col("z.ts").alias("last_at"),
        F.col("a.records_seen").alias("first_records"),
        F.col("z.records_seen").alias("last_records"),
        F.col("a.bytes").alias("first_bytes"),
        F.col("z.bytes").alias("last_bytes"),
    )


def distinct_records(
    stream: DataFrame, keys: list[str], at: str = "ts", watermark: str = WATERMARK
) -> DataFrame:
    """Exact repeats that arrive within the watermark of each other are dropped."""
    return stream.withWatermark(at, watermark).dropDuplicatesWithinWatermark(keys)


def first_of_bursts(
    rows: DataFrame, keys: list[str], at: str = "ts", gap: str = WATERMARK, watermark: str = WATERMARK
) -> DataFrame:
    """T7 with expiry: (keys, first_at, last_at, n) of each burst, in which no two neighbours are ``gap`` or more apart. A repeat after
    that is a burst of its own. On a stream a burst comes out when the watermark has passed its end, and its state
    goes; so there is state for open bursts only, however many keys there are. The same function serves batch and stream."""
    if rows.isStreaming:
        rows = rows.withWatermark(at, watermark)
    return rows.groupBy(*keys, F.session_window(at, gap).alias("w")).agg(
        F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n")
    ).drop("w")
