"""The release ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.maps import clock_text, seconds_between

COUNTERS = ["seen", "inserted", "updated", "skipped", "discarded", "failed"]
# States in which an import is running, and the collection default.
RUNNING = ("importing", "validating")
DONE = "completed"
NOT_DISCOVERED = "not_discovered"


def sum_deltas(deltas: DataFrame, by: str = "release_id") -> DataFrame:
    """Running totals from append-only counter rows."""
    return deltas.groupBy(by).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in COUNTERS])


def reason_rows(ledger: DataFrame, by: list[str], column: str = "discard_reasons") -> DataFrame:
    """One row per entry of a counter map."""
    return ledger.select(*by, F.explode(column).alias("reason", "n"))


def reason_totals(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum per reason (and group)."""
    return rows.groupBy(*(by or []), "reason").agg(F.sum("n").alias("n"))


def reason_map(rows: DataFrame, by: str) -> DataFrame:
    """Reason totals of each group as one map, keys in order."""
    sums = reason_totals(rows, [by])
    entries = F.array_sort(F.collect_list(F.struct("reason", "n")))
    return sums.groupBy(by).agg(F.map_from_entries(entries).alias("discard_reasons"))


def upsert_releases(ledger: DataFrame, found: DataFrame) -> DataFrame:
    """L2: known (collection, identifier) rows keep everything but take a new non-null ``btih``."""
    keys = ["collection", "release_identifier"]
    new = found.groupBy(*keys).agg(F.max("btih").alias("_btih"))
    joined = ledger.withColumn("is_new", F.lit(False)).join(new, keys, "full_outer")
    return joined.withColumn("btih", F.coalesce("_btih", "btih")).withColumn(
        "is_new", F.coalesce("is_new", F.lit(True))
    ).drop("_btih")


def last_write(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """L3/L4: the newest row per key."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, *rest)).alias("_r"))
    return newest.select(*keys, "_r.*")


def last_imported(ledger: DataFrame) -> DataFrame:
    """Identifier of the newest completed release per collection."""
    done = ledger.filter(F.col("status") == DONE)
    at = F.struct("completed_at", "release_identifier")
    return done.groupBy("collection").agg(
        F.max_by("release_identifier", at).alias("last_imported_identifier")
    )


def last_success(ledger: DataFrame) -> DataFrame:
    """A13."""
    return ledger.agg(
        F.max(F.when(F.col("status") == DONE, F.col("completed_at"))).alias("last_success")
    )


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """A14."""
    return ledger.agg(
        F.count("*").alias("releases"),
        F.coalesce(F.sum("records_discarded"), F.lit(0)).alias("discarded"),
        F.coalesce(F.sum("records_failed"), F.lit(0)).alias("failed"),
    )


def latest_per_collection(ledger: DataFrame, by: str = "collection", at: str = "discovered_at",
                          tie: str = "release_identifier") -> DataFrame:
    """The newest row of every collection; an aggregate, so it combines map-side."""
    rest = [c for c in ledger.columns if c != by]
    best = ledger.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_r"))
    return best.select(by, "_r.*")


def collection_overview(
    names: DataFrame, latest: DataFrame, imported: DataFrame, by: str = "collection"
) -> DataFrame:
    """Every wanted collection with its newest release and last import, defaults where absent."""
    return (
        names.join(latest, by, "left")
        .join(imported, by, "left")
        .withColumn("status", F.coalesce("status", F.lit(NOT_DISCOVERED)))
    )


def pending(latest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Latest releases that were not completed yet."""
    keys = ["collection", "release_identifier"]
    done = ledger.filter(F.col("status") == DONE).select(*keys)
    return latest.join(done, keys, "left_anti")


def not_found(wanted: DataFrame, found: DataFrame, by: str = "collection") -> DataFrame:
    """U2."""
    return wanted.select(by).subtract(found.select(by))


def attach_release(
    payloads: DataFrame, ledger: DataFrame, release_id: str = "release_id"
) -> DataFrame:
    """Release id of a payload by collection and identifier, null when unknown."""
    keys = ["collection", "release_identifier"]
    return payloads.join(ledger.select(*keys, release_id), keys, "left")


def recent(ledger: DataFrame, n: int, at: str = "discovered_at", tie: str = "release_identifier") -> DataFrame:
    """The newest ``n`` rows."""
    return ledger.orderBy(F.desc_nulls_last(at), tie).limit(n)


def release_summary(ledger: DataFrame, as_of: Column) -> DataFrame:
    """Durations and display times of each release at the moment ``as_of``."""
    start = F.coalesce("import_started_at", "started_at")
    seconds = (
        F.when(start.isNull(), None)
        .when(F.col("status").isin(*RUNNING), seconds_between(start, as_of))
        .when(F.col("completed_at").isNotNull(), seconds_between(start, F.col("completed_at")))
    )
    return ledger.withColumns(
        {
            "import_seconds": seconds,
            "timing_estimated": F.col("import_started_at").isNull() & F.col("started_at").isNotNull(),
            "started": clock_text(F.col("started_at")),
            "import_started": clock_text(F.col("import_started_at")),
            "completed": clock_text(F.col("completed_at")),
        }
    )


def with_releases(stats: DataFrame, releases: DataFrame) -> DataFrame:
    """Statistics of releases with their identifier and when they were discovered; those of no release are left out."""
    named = releases.select("release_id", "release_identifier", "discovered_at")
    return stats.join(named, "release_id")
