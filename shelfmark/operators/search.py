"""Batch search: query validation, structured filters, ranking, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions.fields import EXTENSION_SHAPE
from shelfmark.functions.identifiers import normalize_doi, normalize_isbn10, normalize_isbn13
from shelfmark.functions.languages import normalize_language
from shelfmark.functions.text import distinct_tokens, normalize_text, tokens
from shelfmark.operators.lookup_index import LookupIndex, looked_up, lookup_of
from shelfmark.operators.text_index import TextIndex, Unindexed, having, match
from shelfmark.operators.workspace import CODEC, Scratch, written

PAGE_SIZE = 20
# Bounds of a request.
PAGE_SIZES, YEARS, POSITIONS = (1, 100), (1000, 2100), (1, 9999)

# Criteria of a raw query table; columns that are absent count as not asked.
RAW_CRITERIA: dict[str, str] = {
    "q": "string",
    "phrase": "string",
    "any_of": "string",
    "exclude": "string",
    "title": "string",
    "author": "string",
    "isbn": "string",
    "doi": "string",
    "language": "string",
    "series": "string",
    "series_position": "int",
    "extension": "string",
    "year_from": "int",
    "year_to": "int",
    "page_size": "int",
    "after_rank": "double",
    "after_md5": "string",
}


def _words(c: Column) -> Column:
    return distinct_tokens(normalize_text(c))


def prepare_queries(raw: DataFrame) -> DataFrame:
    """F16: normalised criteria and ``invalid_reason`` (null when the query can run)."""
    have = {
        n: (F.col(n) if n in raw.columns else F.lit(None)).cast(t) for n, t in RAW_CRITERIA.items()
    }
    q = raw.select("query_id", *[c.alias(n) for n, c in have.items()])
    bad_shape = ~F.lower("extension").rlike(EXTENSION_SHAPE)
    asked = [n for n in RAW_CRITERIA if n not in ("page_size", "after_rank", "after_md5", "exclude")]
    filled = [
        F.coalesce(F.trim(n) != "", F.lit(False)) if RAW_CRITERIA[n] == "string" else F.col(n).isNotNull()
        for n in asked
    ]
    something = filled[0]
    for f in filled[1:]:
        something = something | f
    isbn13, isbn10 = normalize_isbn13(F.col("isbn")), normalize_isbn10(F.col("isbn"))
    no_isbn = (F.col("isbn") != "") & isbn13.isNull() & isbn10.isNull()
    outside = lambda name, bounds: ~F.col(name).between(*bounds)  # noqa: E731  null when it is not asked
    wordless = (F.trim("q") != "") & (F.size(_words(F.col("q"))) == 0)
    reason = (
        F.when(~something, "no criterion")
        .when(wordless, "q without a word")
        .when(outside("page_size", PAGE_SIZES), "invalid page_size")
        .when(outside("year_from", YEARS) | outside("year_to", YEARS), "invalid year")
        .when(outside("series_position", POSITIONS), "invalid series_position")
        .when(F.col("year_from") > F.col("year_to"), "year_from after year_to")
        .when(no_isbn, "invalid isbn")
        .when((F.col("doi") != "") & normalize_doi(F.col("doi")).isNull(), "invalid doi")
        .when(
            (F.col("language") != "") & normalize_language(F.col("language")).isNull(),
            "invalid language",
        )
        .when((F.col("extension") != "") & bad_shape, "invalid extension")
    )
    texts = ["q", "phrase", "any_of", "exclude", "title", "author", "series"]
    q = q.withColumn("_words", F.transform(F.transform(F.array(*texts), normalize_text), tokens))
    words = {n: F.array_distinct(F.get("_words", F.lit(i))) for i, n in enumerate(texts)}
    return q.select(
        "query_id",
        reason.alias("invalid_reason"),
        words["q"].alias("terms"),
        F.get("_words", F.lit(1)).alias("phrase"),
        words["any_of"].alias("any_of"),
        words["exclude"].alias("exclude"),
        words["title"].alias("title_prefixes"),
        words["author"].alias("author_tokens"),
        F.filter(F.array(isbn13, isbn10), lambda x: x.isNotNull()).alias("isbns"),
        normalize_doi(F.col("doi")).alias("doi"),
        normalize_language(F.col("language")).alias("language"),
        words["series"].alias("series_prefixes"),
        "series_position",
        F.nullif(F.lower("extension"), F.lit("")).alias("extension"),
        "year_from",
        "year_to",
        F.coalesce("page_size", F.lit(PAGE_SIZE)).alias("page_size"),
        "after_rank",
        "after_md5",
    )


def has_prefixes(tokens: Column, prefixes: Column) -> Column:
    """every prefix starts some token."""
    return F.forall(prefixes, lambda p: F.exists(tokens, lambda t: F.startswith(t, p)))


def has_all(values: Column, wanted: Column) -> Column:
    """F8: all wanted values are in the list."""
    return F.size(F.array_except(wanted, values)) == 0


def record_filter(
    isbn: str | None = None,
    doi: str | None = None,
    language: str | None = None,
    author: str | None = None,
    title: str | None = None,
    series: str | None = None,
    series_position: int | None = None,
    extension: str | None = None,
    year_from: int | None = None,
    year_to: int | None = None,
) -> Column:
    """F7-F12 for one query: only the conditions that are asked for, so that the comparisons with
    plain columns reach the Parquet scan."""
    cond = ~F.col("deleted")
    if isbn is not None:
        wanted = F.array(normalize_isbn13(F.lit(isbn)), normalize_isbn10(F.lit(isbn)))
        wanted = F.filter(wanted, lambda x: x.isNotNull())
        cond &= F.arrays_overlap("isbn13", wanted) | F.arrays_overlap("isbn10", wanted)
    if doi is not None:
        cond &= F.array_contains("doi", normalize_doi(F.lit(doi)))
    if language is not None:
        cond &= F.array_contains("languages", normalize_language(F.lit(language)))
    if author is not None:
        cond &= has_all(F.col("author_tokens"), _words(F.lit(author)))
    if title is not None:
        cond &= has_prefixes(distinct_tokens(F.col("title_norm")), _words(F.lit(title)))
    if series is not None:
        cond &= has_prefixes(F.col("series_tokens"), _words(F.lit(series)))
    if series_position is not None:
        cond &= F.col("series_position") == series_position
    if extension is not None:
        cond &= F.col("extension") == extension.lower()
    if year_from is not None:
        cond &= F.col("publication_year") >= year_from
    if year_to is not None:
        cond &= F.col("publication_year") <= year_to
    return cond


def _asked_or_true(asked: Column, cond: Column) -> Column:
    return ~asked | F.coalesce(cond, F.lit(False))


def _batch_filter() -> Column:
    """The same conditions between query columns (q.*) and record columns (r.*), ``title_words`` among them."""
    q, r = (lambda n: F.col(f"q.{n}")), (lambda n: F.col(f"r.{n}"))
    no = F.array().cast("array<string>")
    cond = ~r("deleted")
    cond &= _asked_or_true(
        F.size(q("isbns")) > 0,
        F.arrays_overlap(F.concat(r("isbn13"), r("isbn10")), q("isbns")),
    )
    cond &= _asked_or_true(q("doi").isNotNull(), F.array_contains(r("doi"), q("doi")))
    cond &= _asked_or_true(
        q("language").isNotNull(), F.array_contains(r("languages"), q("language"))
    )
    cond &= has_all(F.coalesce(r("author_tokens"), no), q("author_tokens"))
    cond &= (F.size(q("title_prefixes")) == 0) | has_prefixes(r("title_words"), q("title_prefixes"))
    cond &= (F.size(q("series_prefixes")) == 0) | has_prefixes(
        r("series_tokens"), q("series_prefixes")
    )
    for name, ok in (
        ("series_position", r("series_position") == q("series_position")),
        ("extension", r("extension") == q("extension")),
        ("year_from", r("publication_year") >= q("year_from")),
        ("year_to", r("publication_year") <= q("year_to")),
    ):
        cond &= _asked_or_true(q(name).isNotNull(), ok)
    return cond


def _looked_up(lookup: LookupIndex, index: DataFrame | TextIndex | Unindexed | None, q: DataFrame, all_fields: bool, tmp: Scratch) -> DataFrame:
    """(query_id, md5) of queries without text terms, from the lookup values and the index alone."""
    hits = looked_up(lookup, q, all_fields, tmp)
    if not q.filter(F.size("exclude") > 0).isEmpty():
        if index is None:
            raise ValueError("a query excludes words, and there is no index")
        barred = q.select("query_id", F.explode("exclude").alias("token"))
        rows = having(index, barred.select("token").distinct())
        hits = hits.join(barred.join(rows.select("token", "md5"), "token"), ["query_id", "md5"], "left_anti")
    return hits


#: More beginnings of words than that are not looked for one by one, and so many hits are few.
BEGINNINGS, FEW = 1_000, 10_000


def _beginning_as(words: Column, asked: DataFrame) -> Column:
    """The words that begin with the first two letters of some ``title_prefixes``; no other word can begin with one of these."""
    first = asked.select(F.explode("title_prefixes").alias("p")).select(F.expr("left(p, 2)").alias("b")).distinct()
    starts = [r["b"] for r in first.limit(BEGINNINGS + 1).collect()]
    if len(starts) > BEGINNINGS:
        return words
    ones, twos = [b for b in starts if len(b) == 1], [b for b in starts if len(b) == 2]
    return F.filter(words, lambda w: F.substr(w, F.lit(1), F.lit(1)).isin(ones) | F.substr(w, F.lit(1), F.lit(2)).isin(twos))


def _hit_records(records: DataFrame, hits: DataFrame, titles: bool, all_fields: bool, asked: DataFrame | None = None) -> DataFrame:
    """The records that some query hits, with the words a title query looks at: taken apart once for each record, not for each of
    its hits. ``titles``: whether there is such a query; of the words only those are kept that may begin as ``asked``. Few hits are told
    apart before the words are; else the words are made in the scan, so that no title is moved to the hits."""
    if not titles:
        return records.withColumn("title_words", F.array().cast("array<string>"))
    words = tokens(F.col("title_norm"))
    if all_fields:
        words = F.concat(words, "author_tokens", "publisher_tokens")
    words = F.array_distinct(words if asked is None else _beginning_as(words, asked))
    if hits.limit(FEW + 1).count() <= FEW:
        records = records.join(hits.select("md5"), "md5", "left_semi")
    return records.withColumn("title_words", words)


def candidates(
    records: DataFrame,
    index: DataFrame | TextIndex | Unindexed | None,
    queries: DataFrame,
    all_fields: bool = False,
    lookup: LookupIndex | None = None,
) -> DataFrame:
    """Rows of every valid query: (query_id, md5, rank, work_key, edition_count). Without a stored ``lookup`` its values are
    worked out from the records. ``index`` may be none where no query looks for words in the text.

    ``edition_count`` (W1) counts the rows of the same query with the same work key; rows without a
    work key have none. The narrow rows are written once, because the count and the page both read
    them; the other record columns are only fetched for the rows of a page.
    """
    valid = queries.filter(F.col("invalid_reason").isNull())
    textual = (F.size("terms") > 0) | (F.size("any_of") > 0) | (F.size("phrase") > 0)
    # one look at the query table, so that the plan holds only the branches some query needs
    has_text, has_plain = valid.agg(F.max(textual), F.max(~textual)).first()
    with Scratch(records.sparkSession) as tmp:
        hits = None
        if has_text and index is None:
            raise ValueError("a query looks for words in the text, and there is no index")
        if index is not None and (has_text or not has_plain):
            hits = match(index, valid.filter(textual))
        if has_plain or index is None:
            plain = _looked_up(lookup or lookup_of(records), index, valid.filter(~textual), all_fields, tmp)
            plain = plain.withColumn("rank", F.lit(0.0))
            hits = plain if hits is None else hits.unionByName(plain)
        hits = tmp.written(hits, "pairs", CODEC)
        titles = valid.filter(F.size("title_prefixes") > 0)
        rows = (
            hits.alias("h")
            .join(valid.alias("q"), F.col("h.query_id") == F.col("q.query_id"))
            .join(_hit_records(records, hits, not titles.isEmpty(), all_fields, titles).alias("r"), F.col("h.md5") == F.col("r.md5"))
            .filter(_batch_filter())
            .select("h.query_id", "r.md5", F.coalesce("h.rank", F.lit(0.0)).alias("rank"), "r.work_key")
        )
        rows = written(rows, "hits")
    return with_edition_count(rows)


def with_edition_count(rows: DataFrame) -> DataFrame:
    """W1 by a count joined back: it combines map-side, and rows without a work key take no part in it."""
    named = rows.filter(F.col("work_key").isNotNull())
    counts = named.groupBy("query_id", "work_key").agg(F.count("*").alias("edition_count"))
    counted = named.join(counts, ["query_id", "work_key"])
    others = rows.filter(F.col("work_key").isNull()).withColumn("edition_count", F.lit(None).cast("long"))
    return counted.unionByName(others)


def after_key(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """O2: rows after the (rank, md5) a query gives as the end of its previous page."""
    q = queries.select("query_id", "after_rank", "after_md5")
    later = (F.col("rank") < F.col("after_rank")) | (
        (F.col("rank") == F.col("after_rank")) & (F.col("md5") > F.col("after_md5"))
    )
    return (
        rows.join(q, "query_id")
        .filter(F.col("after_rank").isNull() | later)
        .drop("after_rank", "after_md5")
    )


def page(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """O1: one page per query in order of rank and key, with ``place`` from 1 and ``has_next``.

    The longest page asked for, as a plain row-number limit, lets every task drop all but its own best rows
    before the shuffle, however many rows one query has.
    """
    longest = queries.agg(F.max("page_size")).first()[0] or 0
    order = W.partitionBy("query_id").orderBy(F.desc("rank"), F.asc("md5"))
    best = rows.withColumn("place", F.row_number().over(order)).filter(
        F.col("place") <= longest + 1
    )
    best = best.join(queries.select("query_id", "page_size"), "query_id").filter(F.col("place") <= F.col("page_size") + 1)
    size = F.max("place").over(W.partitionBy("query_id"))
    return (
        best.withColumn("has_next", size > F.col("page_size"))
        .filter(F.col("place") <= F.col("page_size"))
        .drop("page_size")
    )


def next_keys(pages: DataFrame) -> DataFrame:
    """O3: per query the (rank, md5) after which its next page starts, null on the last page."""
    return pages.groupBy("query_id").agg(
        F.count("*").alias("rows"),
        F.max_by(F.when(F.col("has_next"), F.col("rank")), "place").alias("after_rank"),
        F.max_by(F.when(F.col("has_next"), F.col("md5")), "place").alias("after_md5"),
    )


def search(
    records: DataFrame,
    index: DataFrame | TextIndex | Unindexed | None,
    raw_queries: DataFrame,
    all_fields: bool = False,
    lookup: LookupIndex | None = None,
) -> DataFrame:
    """A page of results for every row of a query table; a query that is not valid has none."""
    prepared = written(prepare_queries(raw_queries), "queries")
    queries = prepared.filter(F.col("invalid_reason").isNull())
    rows = candidates(records, index, queries, all_fields, lookup)
    return page(after_key(rows, queries), queries).join(records.drop("work_key"), "md5")
