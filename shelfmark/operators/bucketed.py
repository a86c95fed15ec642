"""Keyed tables that change in place as far as they must.

``BucketedTable`` holds one row per key in buckets by a hash of the key. An upsert reads and writes the buckets that hold an
incoming key; all others stay the files they are. ``SeenLog`` remembers which records of which key were merged before:
every merge appends what it adds, with Bloom filters beside it, so that a later merge reads only those parts of the log
that may hold what it asks for. ``compact`` joins the deltas of buckets that have many; ``expire`` removes what only old
versions name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.versions import commit, expire, latest_version, manifest

BUCKETS = 32
ENTRIES = "bucket int, folder string, buckets int"


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(rows: DataFrame, key: str, buckets: int, target: str) -> list[int]:
    """Rows with their ``bucket`` as a folder for each; returns the buckets that have rows. A bucket is written by as many tasks
    as the session has shuffle partitions for each, so few large buckets do not narrow the job."""
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
    seat = [F.pmod(F.xxhash64(F.lit("task"), key), F.lit(tasks))] if tasks > 1 else []
    rows.repartition("bucket", *seat).write.mode("overwrite").partitionBy("bucket").parquet(target)
    there = rows.sparkSession.read.parquet(target).select("bucket").distinct()
    return sorted(r["bucket"] for r in there.collect())


@dataclass(frozen=True)
class BucketedTable:
    """A table below a folder: ``data/version=N/bucket=B`` and manifests. ``buckets`` counts for a new table; an existing one
    keeps its number. Choose it so that a bucket is about a task's share. Null keys have a bucket like any other."""

    spark: SparkSession
    base: str
    key: str = "md5"
    buckets: int = BUCKETS

    def version(self) -> int:
        return latest_version(self.spark, self.base)

    def folders(self, version: int | None = None) -> dict[int, str]:
        """The folder of every bucket that has rows."""
        return {r["bucket"]: r["folder"] for r in manifest(self.spark, self.base, version) if r["bucket"] >= 0}

    def rows(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
        """The rows of a version, of some buckets only if they are named; none if there is no such folder."""
        folders = [f for b, f in sorted(self.folders(version).items()) if buckets is None or b in buckets]
        return self.spark.read.parquet(*[f"{self.base}/{f}" for f in folders]) if folders else None

    def upsert(self, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """A new version: ``merge`` (stored rows, incoming rows) for the buckets that incoming keys fall in. ``incoming`` is
        read several times. Without an incoming row nothing changes."""
        entries = manifest(self.spark, self.base)
        buckets = entries[0]["buckets"] if entries else self.buckets
        own = bucket_of(self.key, buckets)
        touched = {r["bucket"] for r in incoming.select(own.alias("bucket")).distinct().collect()}  # as many as buckets
        before = self.version()
        if not touched:
            return before
        folders = {r["bucket"]: r["folder"] for r in entries if r["bucket"] >= 0}
        stored = [f"{self.base}/{folders[b]}" for b in sorted(touched & set(folders))]
        # the schema of an empty table is that of the merge of incoming rows with none
        base = self.spark.read.parquet(*stored) if stored else incoming.limit(0)
        version = before + 1
        target = f"data/version={version}"
        merged = merge(base, incoming).withColumn("bucket", own)
        there = write_buckets(merged, self.key, buckets, f"{self.base}/{target}")
        folders = {b: f for b, f in folders.items() if b not in touched} | {b: f"{target}/bucket={b}" for b in there}
        rows = [(b, f, buckets) for b, f in sorted(folders.items())] or [(-1, None, buckets)]
        commit(self.spark, self.base, version, rows, ENTRIES)
        return version

    def expire(self, keep: int = 1) -> list[str]:
        """Removes all versions but the last ``keep``, and the folders that none of these names; returns the folders."""
        return expire(self.spark, self.base, keep, ["folder"])


#: Entries for each 64-bit word of a filter, and bits that an entry sets in its word: one in two hundred others hits too.
PER_WORD, BITS = 4, 4
DELTAS = "bucket int, folder string, filter string, words long, n long"


def _filter_mask(h: Column) -> Column:
    """The bits of an entry within its word, from six bits of its hash each."""
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 24 + 6 * k).bitwiseAND(63).cast("int")))
    return mask


@dataclass(frozen=True)
class SeenLog:
    """Which (key, record) were merged before, below a folder: ``deltas/version=N/bucket=B`` and ``filters/version=N``.

    Rows without a record are never in it."""

    spark: SparkSession
    base: str
    key: str = "md5"
    record: str = "aacid"
    buckets: int = BUCKETS

    def _hashed(self, rows: DataFrame) -> DataFrame:
        pairs = rows.where(F.col(self.record).isNotNull()).select(self.key, self.record).distinct()
        return pairs.withColumns({"bucket": bucket_of(self.key, self.buckets), "h": F.xxhash64(self.key, self.record)})

    def _delta(self, pairs: DataFrame, version: int) -> list[tuple]:
        """Writes pairs with their bucket as the delta of a version, and its filters; returns its entries."""
        spark, delta, filters = self.spark, f"deltas/version={version}", f"filters/version={version}"
        write_buckets(pairs.select(self.key, self.record, "bucket"), self.key, self.buckets, f"{self.base}/{delta}")
        # hashed again from what was written, which is narrow
        there = spark.read.parquet(f"{self.base}/{delta}").withColumn("h", F.xxhash64(self.key, self.record))
        sizes = there.groupBy("bucket").agg(F.count("*").alias("n"))
        sizes = sizes.withColumn("words", F.pow(2, F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / PER_WORD)))).cast("long"))
        words = there.join(sizes, "bucket").groupBy("bucket", F.col("h").bitwiseAND(F.col("words") - 1).alias("word"))
        words.agg(F.bit_or(_filter_mask(F.col("h"))).alias("bits")).write.mode("overwrite").parquet(f"{self.base}/{filters}")
        return [(r["bucket"], f"{delta}/bucket={r['bucket']}", filters, r["words"], r["n"]) for r in sizes.collect()]  # one a bucket

    def _entries(self) -> list[tuple]:
        return [(r["bucket"], r["folder"], r["filter"], r["words"], r["n"]) for r in manifest(self.spark, self.base)]

    def _commit(self, version: int, entries: list[tuple]) -> int:
        commit(self.spark, self.base, version, sorted(entries, key=lambda e: (e[1], e[0])), DELTAS)
        return version

    def append(self, rows: DataFrame) -> int:
        """Remembers rows as a delta of their own; nothing that is there is written again. Of no rows nothing is written."""
        pairs, last = self._hashed(rows), latest_version(self.spark, self.base)
        if pairs.isEmpty():
            return last
        return self._commit(last + 1, self._entries() + self._delta(pairs, last + 1))

    def compact(self, most: int = 1) -> int:
        """A new version in which buckets of more than ``most`` deltas have one. Others keep their files; without such a bucket
        there is no new version. Repeated pairs become one."""
        entries, last = self._entries(), latest_version(self.spark, self.base)
        deltas = Counter(e[0] for e in entries)
        crowded = [e for e in entries if deltas[e[0]] > most]
        if not crowded:
            return last
        joined = self._delta(self._hashed(self.pairs([e[1] for e in crowded])), last + 1)
        return self._commit(last + 1, [e for e in entries if deltas[e[0]] <= most] + joined)

    def expire(self, keep: int = 1) -> list[str]:
        """Removes all versions but the last ``keep``, and the deltas and filters that none of these names; returns their folders."""
        return expire(self.spark, self.base, keep, ["folder", "filter"])

    def hit(self, rows: DataFrame) -> list[str]:
        """The folders of deltas that may hold a pair of these rows, by their filters alone."""
        spark, entries = self.spark, manifest(self.spark, self.base)
        if not entries:
            return []
        known = spark.createDataFrame([(r["bucket"], r["folder"], r["filter"], r["words"]) for r in entries], "bucket int, folder string, filter string, words long")
        files = sorted({r["filter"] for r in entries})
        filters = spark.read.parquet(*[f"{self.base}/{f}" for f in files])
        filters = filters.withColumn("filter", F.regexp_extract(F.col("_metadata.file_path"), r"(filters/version=\d+)/", 1))
        filters = filters.join(known, ["bucket", "filter"])
        sizes = known.select("bucket", "words").distinct()
        probes = self._hashed(rows).join(sizes, "bucket").withColumn("word", F.col("h").bitwiseAND(F.col("words") - 1))
        hits = probes.withColumn("mask", _filter_mask(F.col("h"))).join(filters, ["bucket", "words", "word"])
        hits = hits.where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        return sorted(r["folder"] for r in hits.select("folder").distinct().collect())  # as many as deltas and buckets

    def pairs(self, folders: list[str] | None = None) -> DataFrame | None:
        """The remembered pairs, of some folders only if they are named."""
        folders = [r["folder"] for r in manifest(self.spark, self.base)] if folders is None else folders
        if not folders:
            return None
        return self.spark.read.parquet(*[f"{self.base}/{f}" for f in folders]).select(self.key, self.record)

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows that were not merged before; those without a record always pass. Where no filter hits, nothing of the log is
        read."""
        known = self.pairs(self.hit(rows))
        return rows if known is None else rows.join(known, [self.key, self.record], "left_anti")
