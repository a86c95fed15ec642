"""Release manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.identifiers import release_parts

MANIFEST_SCHEMA = (
    "display_name string, is_metadata boolean, obsolete boolean, btih string, url string, "
    "magnet_link string, data_size long"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)


def releases(manifest: DataFrame, allow_obsolete: bool = False) -> DataFrame:
    """(collection, identifier, from_stamp, to_stamp, ...) of the metadata releases."""
    name = F.regexp_replace(F.coalesce("display_name", F.lit("")), r"\.torrent$", "")
    rows = manifest.filter(F.coalesce("is_metadata", F.lit(False)))
    if not allow_obsolete:
        rows = rows.filter(~F.coalesce("obsolete", F.lit(False)))
    rows = rows.select(
        name.alias("identifier"),
        F.coalesce("btih", F.lit("")).alias("btih"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("magnet_link", F.lit("")).alias("magnet_link"),
        F.coalesce("data_size", F.lit(0)).alias("data_size_bytes"),
    )
    rows = rows.withColumn("p", release_parts(F.col("identifier")))
    return rows.filter(F.col("p").isNotNull()).select("p.*", *[c for c in rows.columns if c != "p"])


def latest_releases(found: DataFrame, collections: list[str] | None = None) -> DataFrame:
    """Newest release of each collection; identifiers sort by their end time."""
    if collections is not None:
        found = found.filter(F.col("collection").isin(collections))
    rest = [c for c in found.columns if c not in ("collection", "identifier")]
    best = found.groupBy("collection").agg(
        F.max(F.struct("identifier", *rest)).alias("b")
    )
    return best.select("collection", "b.*")


def pinned_release(manifest: DataFrame, collection: str, suffix: str) -> DataFrame:
    """The one release whose identifier ends with ``suffix``, superseded ones included.

    Fails when none or several match.
    """
    found = releases(manifest, allow_obsolete=True).filter(
        (F.col("collection") == collection) & F.col("identifier").endswith(suffix)
    )
    names = [r["identifier"] for r in found.select("identifier").limit(6).collect()]
    if len(names) != 1:
        raise ValueError(f"{len(names)} releases of {collection} end with {suffix!r}: {names}")
    return found
