"""Lookup values of records kept beside the table (F8-F12): who has a value, and how many do.

``entries`` (kind, value, part, key) is sorted by value within a folder for each kind; ``vocabulary`` (kind, value, df, parts)
is the dictionary of all values. A query by fields is answered from these two: its criteria are looked up in the
dictionary, the beginnings of words as ranges [p, next(p)), and the criterion that fewest records meet is the one whose entries are
read. The entries of very common values are split into parts by a hash of the key.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.fields import YEAR_MAX, YEAR_MIN
from shelfmark.functions.text import distinct_tokens
from shelfmark.operators.text_index import PART, part_of
from shelfmark.operators.workspace import CODEC, Scratch, written

# Kinds of lookup values in which the beginnings of a title query are looked for.
TITLE_KINDS, ALL_KINDS = ("title",), ("title", "author", "publisher")
#: Lengths of the beginnings by which words and prefixes meet; a prefix takes the longest that it has.
BINS = (1, 2, 3, 5, 8)
LAST = "\U0010ffff"


#: All kinds of values.
KINDS = ("isbn", "doi", "author", "publisher", "title", "series", "position", "year", "extension", "language")


class LookupIndex(NamedTuple):
    """``kinds``: what it holds; it can answer no query that asks for another kind."""

    entries: DataFrame
    vocabulary: DataFrame
    key: str = "md5"
    kinds: tuple[str, ...] = KINDS


def identifiers(records: DataFrame, key: str = "md5", kinds: Iterable[str] = KINDS) -> DataFrame:
    """Lookup values of every record: (kind, value, key), one row each. Of the records only what some kind is made of is read."""

    def pairs(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    def single(c: Column) -> Column:
        return F.filter(F.array(c.cast("string")), lambda v: v.isNotNull())

    values = {
        "isbn": F.array_distinct(F.concat("isbn13", "isbn10")),
        "doi": F.array_distinct("doi"),
        "author": F.col("author_tokens"),
        "publisher": F.col("publisher_tokens"),
        "title": distinct_tokens(F.col("title_norm")),
        "series": F.col("series_tokens"),
        "position": single(F.col("series_position")),
        "year": single(F.col("publication_year")),
        "extension": single(F.col("extension")),
        "language": F.array_distinct("languages"),
    }
    entries = F.concat(*[pairs(kind, values[kind]) for kind in kinds])
    return records.select(key, F.explode(entries).alias("e")).select("e.kind", "e.value", key)


def lookup_of(records: DataFrame, key: str = "md5", kinds: tuple[str, ...] = KINDS) -> LookupIndex:
    """The lookup values of a table that has none stored, worked out anew."""
    ids = identifiers(records, key, kinds)
    counts = ids.groupBy("kind", "value").agg(F.count("*").alias("df")).withColumn("parts", F.lit(1))
    return LookupIndex(ids.withColumn("part", F.lit(0)), counts, key, kinds)


def counted_lookup(records: DataFrame, key: str = "md5", kinds: tuple[str, ...] = KINDS) -> LookupIndex:
    """The same with a written dictionary. The entries are read off the records by every search, so none is moved or stored: for a batch
    of queries on long titles, whose entries would be larger than the titles are."""
    lookup = lookup_of(records, key, kinds)
    return lookup._replace(vocabulary=written(lookup.vocabulary, "vocabulary", CODEC))


def write_lookup(records: DataFrame, path: str, key: str = "md5", part: int = PART, kinds: tuple[str, ...] = KINDS) -> None:
    """Stores the lookup values of records, in the order of kind, value and key."""
    with Scratch(records.sparkSession) as tmp:
        ids = tmp.written(identifiers(records, key, kinds), "identifiers", CODEC)
        counts = ids.groupBy("kind", "value").agg(F.count("*").alias("df"))
        counts = tmp.written(counts.withColumn("parts", F.ceil(F.col("df") / part).cast("int")), "counts")
        common = tmp.written(counts.filter(F.col("parts") > 1).select("kind", "value", "parts"), "common")  # at most entries / part of them
        rows = ids.join(common, ["kind", "value"], "left").select(
            "kind", "value", part_of(key, F.coalesce("parts", F.lit(1))).alias("part"), key
        )
        for df, name, order in ((rows, "entries", ["kind", "value", "part", key]), (counts, "vocabulary", ["kind", "value"])):
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
            df.write.mode("overwrite").option("compression", CODEC).partitionBy("kind").parquet(f"{path}/{name}")


def read_lookup(spark: SparkSession, path: str, key: str = "md5", kinds: tuple[str, ...] = KINDS) -> LookupIndex:
    return LookupIndex(spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/vocabulary"), key, kinds)


def criteria(q: DataFrame, all_fields: bool = False) -> DataFrame:
    """(query_id, criterion, kind, value, by_prefix): everything a prepared query asks of fields. A record must meet every
    criterion by one of its values; every word of an author or title is a criterion of its own."""

    def values(kind: str, vals: Column, by_prefix: bool = False) -> Column:
        row = lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(by_prefix).alias("by_prefix"))
        return F.transform(vals, row)

    def one(kind: str, c: Column) -> Column:
        return F.array(values(kind, F.filter(F.array(c.cast("string")), lambda v: v.isNotNull())))

    def each(kinds: tuple[str, ...], vals: str, by_prefix: bool) -> Column:
        return F.transform(vals, lambda v: F.concat(*(values(k, F.array(v), by_prefix) for k in kinds)))

    years = F.when(
        (F.col("year_from") <= YEAR_MAX) | (F.col("year_to") >= YEAR_MIN),
        F.sequence(
            F.greatest(F.coalesce("year_from", F.lit(YEAR_MIN)), F.lit(YEAR_MIN)), F.least(F.coalesce("year_to", F.lit(YEAR_MAX)), F.lit(YEAR_MAX))
        ),
    ).otherwise(F.array())
    every = F.concat(
        F.array(values("isbn", F.col("isbns"))),
        one("doi", F.col("doi")),
        each(("author",), "author_tokens", False),
        each(ALL_KINDS if all_fields else TITLE_KINDS, "title_prefixes", True),
        each(("series",), "series_prefixes", True),
        one("position", F.col("series_position")),
        F.array(values("year", years.cast("array<string>"))),
        one("extension", F.col("extension")),
        one("language", F.col("language")),
    )
    asked = F.filter(every, lambda c: F.size(c) > 0)
    rows = q.select("query_id", F.posexplode(asked).alias("criterion", "values"))
    return rows.select("query_id", "criterion", F.explode("values").alias("e")).select("query_id", "criterion", "e.*")


def bin_length(n: Column) -> Column:
    """The longest of BINS within so many characters."""
    out = F.lit(BINS[0])
    for b in BINS[1:]:
        out = F.when(n >= b, b).otherwise(out)
    return out


def words_of(points: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Points (kind, value, by_prefix and others) as the dictionary words they stand for: (the others, kind, value, df, parts). A
    prefix p is the range of words [p, next(p)); ranges and words meet in bins of words that begin alike, so the join is by
    equality on the bin and only words of that bin are compared."""
    exact = points.filter(~F.col("by_prefix")).join(vocabulary, ["kind", "value"])
    others = [c for c in points.columns if c not in ("value", "by_prefix")]
    columns = [*others, "value", "df", "parts"]
    ranges = points.filter("by_prefix").select(*others, F.col("value").alias("low"), F.concat("value", F.lit(LAST)).alias("high"))
    ranges = ranges.withColumn("bin_length", bin_length(F.length("low"))).withColumn("bin", F.expr("left(low, bin_length)"))
    lengths = ranges.groupBy("kind").agg(F.collect_set("bin_length").alias("lengths"))  # at most as many as BINS for each kind
    binned = vocabulary.join(lengths, "kind").withColumn("bin_length", F.explode(F.filter("lengths", lambda n: n <= F.length("value"))))
    binned = binned.withColumn("bin", F.expr("left(value, bin_length)")).drop("lengths")
    found = ranges.join(binned, ["kind", "bin_length", "bin"]).filter((F.col("value") >= F.col("low")) & (F.col("value") < F.col("high")))
    return exact.select(*columns).unionByName(found.select(*columns))


def rarest_points(lookup: LookupIndex, q: DataFrame, all_fields: bool, tmp: Scratch) -> DataFrame:
    """(query_id, kind, value, parts): the values of the criterion of each query that the fewest entries meet. A query with a
    criterion that nothing meets has none. What several queries ask is counted once; only the rarest criteria are spelt out
    in words."""
    points = tmp.written(criteria(q, all_fields).withColumns({"asked": F.col("value"), "prefix": F.col("by_prefix")}), "points")
    if not points.filter(~F.col("kind").isin(*lookup.kinds)).isEmpty():
        raise ValueError(f"a query asks for a kind of value that is not looked up in {lookup.kinds}")
    what = ["kind", "asked", "prefix"]
    each = lambda df: words_of(df.select(*what, "value", "by_prefix").distinct(), lookup.vocabulary)
    counts = each(points).groupBy(*what).agg(F.sum("df").alias("df"))
    totals = points.join(counts, what, "left").groupBy("query_id", "criterion").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("df"))
    rarest = totals.groupBy("query_id").agg(F.min_by("criterion", F.struct("df", "criterion")).alias("criterion"))
    chosen = tmp.written(points.join(rarest, ["query_id", "criterion"]), "chosen")
    named = chosen.select("query_id", *what).join(each(chosen), what)
    return named.select("query_id", "kind", "value", "parts").distinct()


def looked_up(lookup: LookupIndex, q: DataFrame, all_fields: bool, tmp: Scratch) -> DataFrame:
    """(query_id, key) of the records that meet the rarest criterion of each query. Only folders of kinds and blocks of values that
    are asked for are read."""
    points = tmp.written(rarest_points(lookup, q, all_fields, tmp), "rarest")
    wanted = F.lit(False)
    for r in points.groupBy("kind").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect():  # one row a kind
        wanted = wanted | ((F.col("kind") == r["kind"]) & F.col("value").between(r["low"], r["high"]))
    seats = points.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return seats.join(lookup.entries.filter(wanted), ["kind", "value", "part"]).select("query_id", lookup.key).distinct()
