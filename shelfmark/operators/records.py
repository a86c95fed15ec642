"""The common record: columns, quality score and derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.identifiers import work_key
from shelfmark.functions.text import distinct_tokens, normalize_text, strip_nul, tokens

SCALARS = [
    "title",
    "publisher",
    "publication_year",
    "extension",
    "filesize",
    "series_name",
    "series_position",
    "edition",
]
ARRAYS = ["authors", "languages", "isbn13", "isbn10", "doi", "oclc", "openlibrary_ids"]

RECORD_TYPES: dict[str, str] = {
    "md5": "string",
    "title": "string",
    "authors": "array<string>",
    "publisher": "string",
    "publication_year": "short",
    "languages": "array<string>",
    "extension": "string",
    "filesize": "long",
    "isbn13": "array<string>",
    "isbn10": "array<string>",
    "doi": "array<string>",
    "oclc": "array<string>",
    "openlibrary_ids": "array<string>",
    "series_name": "string",
    "series_position": "short",
    "edition": "string",
    "source_collection": "string",
    "source_record_id": "string",
    "aacid": "string",
    "source_timestamp": "timestamp",
    "deleted": "boolean",
    "removed_reason": "string",
    "ipfs_cid": "string",
    "discard_reason": "string",
}
DERIVED_TYPES: dict[str, str] = {
    "title_norm": "string",
    "author_tokens": "array<string>",
    "publisher_tokens": "array<string>",
    "series_tokens": "array<string>",
    "work_key": "string",
    "quality_score": "short",
}

# What each present field adds to the quality score.
QUALITY_WEIGHTS: dict[str, int] = {
    "title": 10,
    "authors": 8,
    "publisher": 3,
    "publication_year": 3,
    "languages": 2,
    "isbn13": 6,
    "isbn10": 3,
    "doi": 3,
    "oclc": 2,
    "openlibrary_ids": 2,
    "extension": 1,
    "filesize": 1,
    "series_name": 2,
    "series_position": 1,
    "edition": 1,
}


def empty_value(name: str) -> Column:
    kind = RECORD_TYPES[name]
    if kind.startswith("array"):
        return F.array().cast(kind)
    return F.lit(False) if kind == "boolean" else F.lit(None).cast(kind)


def record_columns(**given: Column) -> list[Column]:
    """All record columns in order; fields not given get their empty value."""
    return [
        (F.coalesce(given[n].cast(t), empty_value(n)) if n in given else empty_value(n)).alias(n)
        for n, t in RECORD_TYPES.items()
    ]


def _present(name: str) -> Column:
    c = F.col(name)
    kind = RECORD_TYPES[name]
    if kind.startswith("array"):
        return F.size(c) > 0
    if kind == "string":
        return c.isNotNull() & (c != "")
    if name == "series_position":
        return c.isNotNull()
    return c.isNotNull() & (c != 0)  # a file size of 0 adds nothing


def quality_score(fields: list[str] | None = None) -> Column:
    """A2: weighted count of the present fields (all of them unless named)."""
    total = F.lit(0)
    for name, weight in QUALITY_WEIGHTS.items():
        if fields is None or name in fields:
            total = total + F.when(_present(name), weight).otherwise(0)
    return total.cast("short")


def with_derived(df: DataFrame, score: bool = True) -> DataFrame:
    """NUL-free text plus the derived columns, so that searches never normalise stored text.

    Merged rows keep the score the merge gave them (``score=False``).
    """
    return with_title(without_title(df, score))


def with_title(df: DataFrame) -> DataFrame:
    """The title and what is derived from it."""
    clean = df.withColumn("title", strip_nul(F.coalesce("title", F.lit(""))))
    return clean.withColumn("title_norm", normalize_text(F.col("title")))


def without_title(df: DataFrame, score: bool = True) -> DataFrame:
    """All of ``with_derived`` but the title, which may be absent."""
    clean = df.withColumns(
        {
            "publisher": strip_nul(F.col("publisher")),
            "series_name": strip_nul(F.col("series_name")),
            "edition": strip_nul(F.col("edition")),
            "authors": F.transform(
                F.filter("authors", lambda a: a.isNotNull() & (a != "")), strip_nul
            ),
            "languages": F.transform("languages", strip_nul),
        }
    )
    texts = F.concat(F.array("publisher", "series_name"), "authors")
    clean = clean.withColumn("_norm", F.transform(texts, normalize_text))
    names = F.slice("_norm", F.lit(3), F.greatest(F.size("_norm") - 2, F.lit(0)))
    derived = {
        "author_tokens": F.array_distinct(F.flatten(F.transform(names, distinct_tokens))),
        "publisher_tokens": tokens(F.get("_norm", F.lit(0))),
        "series_tokens": distinct_tokens(F.get("_norm", F.lit(1))),
        "work_key": work_key(*[F.col(n) for n in ("isbn13", "isbn10", "doi", "openlibrary_ids")]),
    }
    if score:
        derived["quality_score"] = quality_score()
    return clean.withColumns(derived).drop("_norm")
