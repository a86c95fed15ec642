"""Keyed tables: merge and overwrite upserts, replay protection, purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators.merge import HOT_ROWS, MergeSpec, merge_versions

# Overwrite mode: columns that keep the stored value when the incoming one is null.
KEEP_WHEN_NULL = ("series_name", "series_position", "edition", "source_timestamp", "ipfs_cid")


# What a version says, besides its key, its arrival and its record reference.
VERSION_CONTENT = tuple(c for c in MergeSpec().columns() if c not in ("md5", "seq", "aacid"))


def before_all(kind: T.DataType) -> Column:
    """An arrival before any other: a stored row is the version before all incoming ones."""
    if isinstance(kind, T.StructType):
        return F.struct(*(before_all(f.dataType).alias(f.name) for f in kind.fields))
    return F.lit("" if isinstance(kind, T.StringType) else -1).cast(kind)


def upsert_merge(
    stored: DataFrame, incoming: DataFrame, spec: MergeSpec | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The stored rows and all incoming versions folded by the quality rule.

    ``stored`` holds one row per key; its score and timestamp are the running maxima, so merging batch
    by batch gives the same rows as one merge of everything.
    """
    spec = spec or MergeSpec()
    first = stored.withColumn(spec.seq, before_all(incoming.schema[spec.seq].dataType))
    rows = first.select(*spec.columns()).unionByName(incoming.select(*spec.columns()))
    return merge_versions(rows, spec, hot_rows)


def upsert_overwrite(
    stored: DataFrame,
    incoming: DataFrame,
    key: str = "md5",
    keep_when_null: tuple[str, ...] = KEEP_WHEN_NULL,
    greatest: tuple[str, ...] = ("quality_score",),
) -> DataFrame:
    """One incoming row per key replaces the stored one, except for a few columns.

    ``created_at`` stays, ``updated_at`` becomes that of the incoming row where both are present.
    """
    new, old = incoming.alias("n"), stored.alias("o")
    joined = new.join(old, F.col(f"n.{key}") == F.col(f"o.{key}"), "full_outer")
    there = F.col(f"n.{key}").isNotNull()
    out = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    for name in stored.columns:
        n, o = F.col(f"n.{name}"), F.col(f"o.{name}")
        if name == key:
            continue
        if name == "created_at":
            value = F.coalesce(o, n)
        elif name in greatest:
            value = F.greatest(n, o)
        elif name in keep_when_null:
            value = F.coalesce(n, o)
        else:
            value = F.when(there, n).otherwise(o)
        out.append(value.alias(name))
    return joined.select(*out)


def upsert_counts(stored: DataFrame, incoming: DataFrame, key: str = "md5") -> DataFrame:
    """How many incoming keys are new and how many are already there."""
    keys = incoming.select(key).filter(F.col(key).isNotNull()).distinct()
    marked = keys.join(stored.select(key).withColumn("_old", F.lit(True)), key, "left")
    return marked.agg(
        F.count_if(F.col("_old").isNull()).alias("inserted"),
        F.count_if(F.col("_old").isNotNull()).alias("updated"),
    )


def unseen(
    incoming: DataFrame, seen: DataFrame, key: str = "md5", record: str = "aacid"
) -> DataFrame:
    """T5: versions that were not merged before. Rows without a record reference always pass."""
    known = seen.select(key, record).distinct()
    return incoming.join(known, [key, record], "left_anti")


def once_per_record(
    incoming: DataFrame, key: str = "md5", record: str = "aacid", seq: str = "seq", content: tuple[str, ...] = ()
) -> DataFrame:
    """Repeats of a record reference within one input, the first arrival kept. With ``content`` only rows that are alike in these
    columns too are repeats, so a second version under the same reference stays to be merged."""
    named = incoming.filter(F.col(record).isNotNull())
    # the limit on the place drops repeats in every task before the shuffle
    place = F.row_number().over(W.partitionBy(key, record, *content).orderBy(seq))
    firsts = named.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")
    return firsts.unionByName(incoming.filter(F.col(record).isNull()))


def kept_rows(rows: DataFrame, keep: list[str], column: str = "source_collection") -> DataFrame:
    """rows of the collections to keep, and rows of none, which no purge names."""
    if not keep:
        raise ValueError("an empty keep list would purge everything")
    return rows.filter(F.col(column).isin(keep) | F.col(column).isNull())


def purged_rows(rows: DataFrame, keep: list[str], column: str = "source_collection") -> DataFrame:
    if not keep:
        raise ValueError("an empty keep list would purge everything")
    return rows.filter(~F.col(column).isin(keep))


def strays(rows: DataFrame, keep: list[str], column: str = "source_collection") -> DataFrame:
    """Count per collection that should be gone; empty after a complete purge."""
    return purged_rows(rows, keep, column).groupBy(column).agg(F.count("*").alias("n"))


def purge(
    tables: dict[str, tuple[DataFrame, str]], keep: list[str], backup: str, target: str
) -> dict[str, int]:
    """Back up what goes, write what stays, verify; returns removed rows per table.

    ``tables`` maps a name to (rows, collection column). Before anything of the target is written, the rows that stay
    and the rows in the backup are checked to be all rows of every table.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    removed = {}
    for name, (rows, column) in tables.items():
        purged_rows(rows, keep, column).write.mode("overwrite").parquet(f"{backup}/{name}")
        every, stay = rows.count(), kept_rows(rows, keep, column).count()
        removed[name] = spark.read.parquet(f"{backup}/{name}").count()
        if stay + removed[name] != every:
            raise RuntimeError(f"backup of {name} is incomplete: {stay} + {removed[name]} of {every}")
    for name, (rows, column) in tables.items():
        kept_rows(rows, keep, column).write.mode("overwrite").parquet(f"{target}/{name}")
        left = strays(spark.read.parquet(f"{target}/{name}"), keep, column).limit(5).collect()
        if left:
            raise RuntimeError(f"purge of {name} is incomplete: {left}")
    return removed
