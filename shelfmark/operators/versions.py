"""Versions of a stored table: which folders hold it now.

A version is one small table below ``manifests/version=N``, written last and in one file, so it is there or it is not. What a
failed attempt has written lies in folders named by the version it was to become; the next attempt has the same
number and replaces them. So there are no orphans, and readers keep the version they have.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.workspace import remove_folder


def manifests(spark: SparkSession, base: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{base}/manifests")
    except AnalysisException:  # no version yet
        return None


def latest_version(spark: SparkSession, base: str) -> int:
    """The number of the last committed version, 0 if there is none."""
    found = manifests(spark, base)
    return 0 if found is None else found.agg(F.max("version")).first()[0]


def manifest(spark: SparkSession, base: str, version: int | None = None) -> list[Row]:
    """The entries of a version, the last one if none is named. There are as many as folders, not as rows."""
    found = manifests(spark, base)
    if found is None:
        return []
    if version is None:
        version = found.agg(F.max("version")).first()[0]
    return found.where(F.col("version") == version).collect()


def commit(spark: SparkSession, base: str, version: int, entries: list[tuple], schema: str) -> None:
    """Makes a version current."""
    rows = spark.createDataFrame(entries, schema).coalesce(1)
    rows.write.mode("overwrite").parquet(f"{base}/manifests/version={version}")


def expire(spark: SparkSession, base: str, keep: int, columns: list[str]) -> list[str]:
    """Removes all versions but the last ``keep``, and the folders named in the columns that only removed ones name; returns these
    folders. Manifests go last, so one that was stopped is finished by the next. Readers of the versions that are kept notice
    nothing; no writer may be at work."""
    if keep < 1:
        raise ValueError("the last version stays")
    found = manifests(spark, base)
    rows = [] if found is None else found.collect()  # as many as folders in all versions
    kept = sorted({r["version"] for r in rows})[-keep:]
    named = lambda old: {r[c] for r in rows for c in columns if (r["version"] not in kept) == old and r[c] is not None}
    gone = sorted(named(True) - named(False))
    versions = sorted({r["version"] for r in rows} - set(kept))
    for folder in [*gone, *(f"manifests/version={v}" for v in versions)]:
        remove_folder(spark, f"{base}/{folder}")
    return gone
