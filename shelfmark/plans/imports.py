"""Batch import of one release: scan, map, count, gate, merge, derive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import tokens
from shelfmark.operators.discards import ABORT_RATE, check_error_rate, import_counters
from shelfmark.operators.gate import ErrorGate
from shelfmark.operators.merge import HOT_ROWS
from shelfmark.operators.records import quality_score, with_derived
from shelfmark.operators.tables import VERSION_CONTENT, once_per_record, unseen, upsert_merge
from shelfmark.operators.text_index import Unindexed, add_segment, build_index
from shelfmark.operators.workspace import new_dir
from shelfmark.sources.adapters import AdapterSettings, adapt
from shelfmark.sources.jsonl import read_lines


@dataclass
class ImportResult:
    parsed: DataFrame
    records: DataFrame
    counters: dict[str, int]
    seen: DataFrame


def import_release(
    spark: SparkSession,
    path: str | list[str],
    collection: str,
    stored: DataFrame | None = None,
    seen: DataFrame | None = None,
    release_rank: int = 1,
    settings: AdapterSettings = AdapterSettings(),
    tolerant: bool = False,
    abort_rate: float = ABORT_RATE,
    hot_rows: int = HOT_ROWS,
) -> ImportResult:
    """Merged records after one release. The parsed rows are written once to the shared folder and
    serve the counters, the gate, the quarantine and the merge. The gate also ends the scan early when
    too many lines have failed. Equal versions under one record reference count once; ``seen`` is what to remember for
    the next release."""
    lines = read_lines(spark, path, release_rank, tolerant)
    gate = ErrorGate(spark, abort_rate)
    target = new_dir(spark, "parsed")
    gate.write(gate.watched(adapt(lines, collection, settings).withColumn("quality_score", quality_score())), target)
    parsed = spark.read.parquet(target)
    counters = import_counters(parsed).first()
    check_error_rate(counters, abort_rate)
    rows = once_per_record(parsed.filter(F.col("outcome") == "kept"), content=VERSION_CONTENT)
    if seen is not None:
        rows = unseen(rows, seen)
    base = rows.limit(0) if stored is None else stored
    merged = with_derived(upsert_merge(base, rows, hot_rows=hot_rows), score=False)
    named = parsed.filter((F.col("outcome") == "kept") & F.col("aacid").isNotNull()).select("md5", "aacid")
    known = named.distinct() if seen is None else seen.select("md5", "aacid").unionByName(named).distinct()
    return ImportResult(parsed, merged, counters.asDict(), known)


def index_fields() -> dict[str, Column]:
    """What is searchable of a record: title, authors, publisher."""
    return {
        "A": tokens(F.col("title_norm")),
        "B": F.col("author_tokens"),
        "C": F.col("publisher_tokens"),
    }


def index_records(records: DataFrame) -> DataFrame:
    return build_index(records.filter(~F.col("deleted")), index_fields())


def unindexed_records(records: DataFrame) -> Unindexed:
    """The same records to be searched without an index."""
    return Unindexed(records.filter(~F.col("deleted")), index_fields())


def refresh_index(spark: SparkSession, path: str, changed: DataFrame) -> int:
    """L1: the stored index with the entries of changed records rebuilt, removed ones among them, in a segment of their own."""
    return add_segment(spark, path, index_records(changed), changed.select("md5"))
