"""Lookups by key and by work, and the shape of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.identifiers import md5_hex
from shelfmark.functions.text import strip

# Fixed value: shape of a work key.
WORK_KEY_SHAPE = r"^(isbn|doi|ol):.+"


def by_key(records: DataFrame, wanted: DataFrame, column: str = "md5") -> DataFrame:
    """Records of a table of keys; ``status`` is ok, removed, missing or invalid."""
    keys = wanted.select(F.col(column).alias("asked"), md5_hex(F.col(column)).alias("md5"))
    hits = keys.join(records.withColumn("_hit", F.lit(True)), "md5", "left")
    status = (
        F.when(F.col("md5").isNull(), "invalid")
        .when(F.col("_hit").isNull(), "missing")
        .when(F.col("deleted"), "removed")
        .otherwise("ok")
    )
    return hits.withColumn("status", status).drop("_hit")


def source_references(looked_up: DataFrame) -> DataFrame:
    """Where a record comes from, shown only when it is there and not removed."""
    ok = F.col("status") == "ok"
    shown = ["source_collection", "source_record_id", "aacid", "ipfs_cid"]
    return looked_up.select("asked", "status", *[F.when(ok, F.col(c)).alias(c) for c in shown])


def editions(records: DataFrame, works: DataFrame, column: str = "work_key") -> DataFrame:
    """Live records of a table of work keys with the number of editions of the work."""
    asked = works.select(strip(F.col(column)).alias("work_key")).distinct()
    asked = asked.filter(F.col("work_key").rlike(WORK_KEY_SHAPE))
    live = records.filter(~F.col("deleted") & F.col("work_key").isNotNull())
    rows = live.join(asked, "work_key", "left_semi")
    counts = rows.groupBy("work_key").agg(F.count("*").alias("total_editions"))
    return rows.join(counts, "work_key")


def best_first(rows: DataFrame) -> DataFrame:
    """O4."""
    return rows.orderBy("work_key", F.desc("quality_score"), F.asc("md5"))


def edition_sizes(records: DataFrame) -> DataFrame:
    """Live records per work."""
    live = records.filter(~F.col("deleted") & F.col("work_key").isNotNull())
    return live.groupBy("work_key").agg(F.count("*").alias("editions"))


def response(rows: DataFrame) -> DataFrame:
    """P10: flat record to the nested answer."""
    count = F.col("edition_count") if "edition_count" in rows.columns else F.lit(None).cast("long")
    return rows.select(
        F.lower("md5").alias("md5"),
        F.coalesce("title", F.lit("")).alias("title"),
        "authors",
        "publisher",
        F.col("publication_year").alias("publicationYear"),
        "languages",
        F.col("extension").alias("format"),
        "filesize",
        F.struct(
            "isbn10", "isbn13", "doi", "oclc", F.col("openlibrary_ids").alias("openlibrary")
        ).alias("identifiers"),
        F.col("work_key").alias("workKey"),
        F.col("series_name").alias("seriesName"),
        F.col("series_position").alias("seriesPosition"),
        "edition",
        F.struct(
            F.col("source_collection").alias("collection"),
            F.col("source_record_id").alias("record_id"),
            "aacid",
        ).alias("source"),
        F.nullif(count, F.lit(0)).alias("editionCount"),
    )
