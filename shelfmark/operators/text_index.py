"""The text index (X22) and matching of query tables against it.

The index has one row per (token, key) with all places of the token in that record, so a query
never groups raw occurrences again. Matching starts from the rarest required term of each query
and checks the other terms by an equi-join on (token, key): the work is bounded by the document
frequency of the rarest term, however common the others are.

Records need not be indexed for one batch of queries (``Unindexed``): their words are read once, the rarest terms give the pairs of
query and record, and entries are made for the words that the queries of a record ask for.

A stored index is a list of immutable segments. Records that change are indexed in a segment of their own, which
overrules what older segments say of its keys; no old segment is written again until segments are compacted. Each segment
knows the frequency of its tokens and splits the entries of common ones into parts by a hash of the key, so that a join on a
token is a join on (token, part), in which only the query side is repeated.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.versions import commit, latest_version, manifest
from shelfmark.operators.workspace import CODEC, Scratch, settings, written

# Weights of the three indexed fields.
FIELD_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}
# Ranks are rounded, so that a page that starts after (rank, key) finds the same rank again.
RANK_DIGITS = 9
QUERY_LISTS = ("terms", "any_of", "exclude", "phrase")


def build_index(records: DataFrame, fields: dict[str, Column], key: str = "md5", only: str | None = None) -> DataFrame:
    """(token, key, places) from token lists per field; positions run on over the fields. ``only``: a column with the list
    of tokens that are wanted of a record; the places are those among all its tokens."""

    def labelled(label: str, words: Column) -> Column:
        return F.transform(words, lambda t: F.struct(t.alias("token"), F.lit(label).alias("field")))

    if only is None:
        parts = [labelled(label, words) for label, words in fields.items()]
        spots = F.transform(
            F.concat(*parts), lambda w, i: F.struct(w["token"].alias("token"), i.alias("pos"), w["field"].alias("field"))
        )
    else:
        records, spots = _asked_spots(records, fields, key, only)
    # grouped within the row: sorted by token, then cut where the token changes; nothing is shuffled
    # (sort_array compares natively, array_sort by a lambda for each pair)
    rows = records.select(key, F.sort_array(spots).alias("_s"))
    new = lambda w, i: (i == 0) | (w["token"] != F.get("_s", i - 1)["token"])
    starts = F.transform("_s", lambda w, i: F.when(new(w, i), i + 1))
    rows = rows.select(key, "_s", F.array_compact(starts).alias("_from"))
    until = F.concat(F.slice("_from", 2, F.size("_from")), F.array(F.size("_s") + 1))
    groups = F.transform(
        F.arrays_zip(F.col("_from").alias("a"), until.alias("b")),
        lambda g: F.struct(
            F.get("_s", g["a"] - 1)["token"].alias("token"),
            F.transform(
                F.slice("_s", g["a"], g["b"] - g["a"]), lambda x: F.struct(x["pos"].alias("pos"), x["field"].alias("field"))
            ).alias("places"),
        ),
    )
    return rows.select(key, F.explode(groups).alias("g")).select("g.token", key, "g.places")


def _asked_spots(records: DataFrame, fields: dict[str, Column], key: str, only: str) -> tuple[DataFrame, Column]:
    """Records with their tokens, and the spots of the wanted ones. Of all tokens only a number is made, and that where they are wanted."""
    words = {f"_{label}": tokens for label, tokens in fields.items()}
    rows = records.select(key, only, *[c.alias(n) for n, c in words.items()])
    rows = rows.select(key, only, F.concat(*words).alias("_w"), *[F.size(n).alias(n) for n in words])
    at = F.array_compact(F.transform("_w", lambda t, i: F.when(F.array_contains(only, t), i)))

    def field(i: Column) -> Column:
        """The first field that ends after the place."""
        ends = [sum((F.col(n) for n in list(words)[:m]), F.lit(0)) for m in range(1, len(words) + 1)]
        return F.coalesce(*[F.when(i < end, F.lit(label)) for label, end in zip(fields, ends, strict=True)])

    return rows, F.transform(at, lambda i: F.struct(F.get("_w", i).alias("token"), i.alias("pos"), field(i).alias("field")))


#: Entries of a token in one part of it.
PART = 50_000
#: What one task reads to make a sorted file of a segment, so that it sorts in memory.
RUN = "32m"
SEGMENTS = "segment int"


class TextIndex(NamedTuple):
    """A stored index: ``entries`` (segment, token, part, key, places), ``vocabulary`` (segment, token, df, parts) and, if there
    is more than one segment, ``latest`` (key, latest): the newest segment that speaks for a key of a later one. ``newest`` is
    the newest of all."""

    entries: DataFrame
    vocabulary: DataFrame
    latest: DataFrame | None = None
    key: str = "md5"
    newest: int | None = None

    def living(self, rows: DataFrame) -> DataFrame:
        """Without the entries that newer segments overrule. Those of the newest segment need not be looked at."""
        if self.latest is None:
            return rows
        older = rows if self.newest is None else rows.filter(F.col("segment") != self.newest)
        ruled = older.join(self.latest, self.key, "left").filter(F.coalesce("latest", F.lit(0)) <= F.col("segment"))
        ruled = ruled.select(*rows.columns)
        return ruled if self.newest is None else ruled.unionByName(rows.filter(F.col("segment") == self.newest))

    def rows(self) -> DataFrame:
        """All valid entries as (token, key, places)."""
        return self.living(self.entries).select("token", self.key, "places")


def stored_segment(entries: DataFrame, keys: DataFrame | None, path: str, number: int, key: str = "md5", part: int = PART) -> None:
    """Writes entries (token, key, places) as a segment of sorted files: each is sorted by token, part and key, so that a scan for some
    tokens prunes by min/max. A file holds all entries of the records that one task read; none is moved. ``keys``: what the segment speaks for, records without a word among them; the first segment needs none."""
    spark = entries.sparkSession
    with Scratch(spark) as tmp, settings(spark, {"spark.sql.files.maxPartitionBytes": RUN}):
        entries = tmp.written(entries, "entries", CODEC)  # read for the counts and again for the parts
        counts = entries.groupBy("token").agg(F.count("*").alias("df"))
        counts = tmp.written(counts.withColumn("parts", F.ceil(F.col("df") / part).cast("int")), "counts")
        # of these there are at most as many as entries / part; written, so that their number is known to the join
        common = tmp.written(counts.filter(F.col("parts") > 1).select("token", "parts"), "common")
        rows = entries.join(common, "token", "left") if not common.isEmpty() else entries.withColumn("parts", F.lit(None).cast("int"))
        rows = rows.select("token", part_of(key, F.coalesce("parts", F.lit(1))).alias("part"), key, "places")
        ordered = rows.sortWithinPartitions("token", "part", key)
        ordered.write.mode("overwrite").option("compression", CODEC).parquet(f"{path}/entries/segment={number}")
        counts = counts.repartitionByRange("token").sortWithinPartitions("token")
        counts.write.mode("overwrite").parquet(f"{path}/vocabulary/segment={number}")
        if keys is not None:
            keys.select(key).distinct().write.mode("overwrite").parquet(f"{path}/keys/segment={number}")


def part_of(key: Column | str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), parts).cast("int")


def write_index(index: DataFrame, path: str, key: str = "md5", part: int = PART) -> None:
    """A stored index of one segment."""
    stored_segment(index, None, path, 1, key, part)
    commit(index.sparkSession, path, 1, [(1,)], SEGMENTS)


def read_index(spark: SparkSession, path: str, key: str = "md5", version: int | None = None) -> TextIndex:
    """The stored index as it is now, or as an older version had it."""
    segments = sorted(r["segment"] for r in manifest(spark, path, version))
    read = lambda kind, which: spark.read.option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/segment={n}" for n in which])
    latest = None
    if len(segments) > 1:
        latest = read("keys", segments[1:]).groupBy(key).agg(F.max("segment").alias("latest"))
    return TextIndex(read("entries", segments), read("vocabulary", segments), latest, key, segments[-1])


def add_segment(spark: SparkSession, path: str, entries: DataFrame, keys: DataFrame, key: str = "md5", part: int = PART) -> int:
    """A new version, in which a segment of its own speaks for the keys; their entries in older segments no longer count."""
    before = [r["segment"] for r in manifest(spark, path)]
    number = latest_version(spark, path) + 1
    stored_segment(entries, keys, path, number, key, part)
    commit(spark, path, number, [(n,) for n in [*before, number]], SEGMENTS)
    return number


def compacted(spark: SparkSession, path: str, key: str = "md5", part: int = PART) -> int:
    """A new version with all valid entries in one segment. Older versions stay readable."""
    number = latest_version(spark, path) + 1
    stored_segment(read_index(spark, path, key).rows(), None, path, number, key, part)
    commit(spark, path, number, [(number,)], SEGMENTS)
    return number


class Unindexed(NamedTuple):
    """Records whose entries are made for each batch of queries: ``fields`` are their token lists, as for ``build_index``."""

    records: DataFrame
    fields: dict[str, Column]
    key: str = "md5"

    def words(self, tokens: DataFrame) -> DataFrame:
        """(segment, token, part, key) of the records that hold some tokens, without places; all is one part."""
        every = F.array_distinct(F.concat(*self.fields.values()))
        held = self.records.select(self.key, F.explode(every).alias("token")).join(tokens, "token", "left_semi")
        return held.select(F.lit(0).alias("segment"), "token", F.lit(0).alias("part"), self.key)

    def entries(self, wanted: DataFrame) -> DataFrame:
        """(token, key, places) of some (key, token)."""
        lists = wanted.groupBy(self.key).agg(F.collect_set("token").alias("_only"))
        return build_index(self.records.join(lists, self.key), self.fields, self.key, "_only")


def having(index: DataFrame | TextIndex | Unindexed, tokens: DataFrame) -> DataFrame:
    """(segment, token, part, key, places) of the valid entries of some tokens. Of an index that is not stored, all is one part."""
    if isinstance(index, TextIndex):
        return index.living(index.entries.join(tokens, "token", "left_semi"))
    if isinstance(index, Unindexed):
        index = build_index(index.records, index.fields, index.key)
    plain = index.join(tokens, "token", "left_semi")
    return plain.withColumns({"segment": F.lit(0), "part": F.lit(0)})


def frequencies(index: DataFrame | TextIndex, rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """(segment, token, df, parts) of some tokens, from the stored vocabulary if there is one, else counted in ``rows``."""
    if isinstance(index, TextIndex):
        return index.vocabulary.join(tokens, "token", "left_semi").select("segment", "token", "df", "parts")
    counted = rows.groupBy("segment", "token").agg(F.count("*").alias("df"))
    return counted.withColumn("parts", F.lit(1))


def with_token(asked: DataFrame, rows: DataFrame, spread: DataFrame) -> DataFrame:
    """``asked`` (with a token) joined with the entries of its token, part by part."""
    seats = asked.join(spread.select("segment", "token", "parts"), "token")
    seats = seats.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return seats.join(rows, ["segment", "token", "part"])


def _queries(queries: DataFrame) -> DataFrame:
    """Query table with all token lists present; phrase tokens are required terms as well."""
    none = F.array().cast("array<string>")
    lists = {
        n: F.coalesce(F.col(n), none) if n in queries.columns else none for n in QUERY_LISTS
    }
    q = queries.select("query_id", *[v.alias(n) for n, v in lists.items()])
    return q.withColumn("terms", F.array_distinct(F.concat("terms", "phrase")))


def _asks() -> Column:
    """What a query wants to know of a record, one entry per token: the number of the required term
    (-1 if none), whether the token scores, may be any of a set or bars the record, and its places
    in the phrase."""
    words = F.array_distinct(F.concat("terms", "any_of", "exclude"))

    def ask(t: Column) -> Column:
        return F.struct(
            t.alias("token"),
            (F.array_position("terms", t) - 1).cast("int").alias("term"),
            F.array_contains("any_of", t).alias("either"),
            F.array_contains("exclude", t).alias("bars"),
            F.filter(
                F.transform("phrase", lambda w, i: F.when(w == t, i)), lambda i: i.isNotNull()
            ).alias("steps"),
        )

    return F.transform(words, ask)


def starting_pairs(rows: DataFrame, spread: DataFrame, q: DataFrame, key: str) -> DataFrame:
    """(query_id, key) worth checking: records with the rarest required term of the query, or with
    one of ``any_of`` when nothing is required."""
    totals = spread.groupBy("token").agg(F.sum("df").alias("df"))
    by_term = q.select("query_id", F.explode("terms").alias("token")).join(totals, "token", "left")
    rarest = by_term.groupBy("query_id").agg(
        F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), "token")).alias("token")
    )
    loose = q.filter(F.size("terms") == 0).select("query_id", F.explode("any_of").alias("token"))
    hits = with_token(rarest.unionByName(loose), rows.select("segment", "token", "part", key), spread)
    return hits.select("query_id", key).distinct()


def match(
    index: DataFrame | TextIndex | Unindexed,
    queries: DataFrame,
    key: str = "md5",
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """(query_id, key, rank) of the records that hold all ``terms``, the ``phrase`` in
    sequence, one of ``any_of`` (when given) and none of ``exclude``.

    A query without terms and any_of matches nothing here. The rank is the cover density over the
    required terms, saturated to r/(r+1); with only ``any_of`` every occurrence scores its weight.
    """
    weights = weights or FIELD_WEIGHTS
    q = _queries(queries).withColumn("asks", _asks())
    asked = q.select(F.explode("asks.token").alias("token")).distinct()
    scanned = isinstance(index, Unindexed)
    if scanned:  # read for the counts and again for the pairs
        q, asked = written(q, "asked", CODEC), written(asked, "tokens", CODEC)
        rows = written(index.words(asked), "words", CODEC)
    else:
        rows = having(index, asked)
    spread = frequencies(index, rows, asked)
    needs = q.select(
        "query_id",
        "asks",
        F.size("terms").alias("k"),
        F.size("phrase").alias("steps"),
        (F.size("any_of") > 0).alias("wants_any"),
    )
    starts = starting_pairs(rows, spread, q, key)
    if scanned:
        starts = written(starts, "starts", CODEC)
        terms = q.select("query_id", F.explode("asks.token").alias("token"))
        entries = index.entries(starts.join(terms, "query_id").select(key, "token"))
    else:
        entries = rows.drop("segment", "part")
    pairs = starts.join(needs, "query_id")
    wanted = pairs.select(
        "query_id", key, "k", "steps", "wants_any", F.explode("asks").alias("ask")
    ).withColumn("token", F.col("ask.token"))
    found = wanted.join(entries, ["token", key])

    scores = F.when(F.col("k") > 0, F.col("ask.term") >= 0).otherwise(F.col("ask.either"))
    events = F.transform(
        "places",
        lambda p: F.struct(
            p["pos"].alias("pos"),
            F.col("ask.term").alias("term"),
            _weight(p["field"], weights).alias("w"),
        ),
    )
    lines = F.transform(
        "ask.steps", lambda i: F.transform("places", lambda p: p["pos"] - i)
    )
    checked = (
        found.groupBy("query_id", key, "k", "steps", "wants_any")
        .agg(
            F.count_if(F.col("ask.term") >= 0).alias("held"),
            F.max("ask.either").alias("either"),
            F.max("ask.bars").alias("barred"),
            F.sort_array(F.flatten(F.collect_list(F.when(scores, events)))).alias("events"),
            F.flatten(F.collect_list(lines)).alias("lines"),
        )
        .filter(
            (F.col("held") == F.col("k"))
            & (~F.col("wants_any") | F.col("either"))
            & ~F.col("barred")
        )
        .filter((F.col("steps") == 0) | _in_sequence(F.col("lines")))
    )
    loose = F.aggregate("events", F.lit(0.0), lambda a, e: a + e["w"])
    score = F.when(F.col("k") > 0, _cover_score(F.col("events"), F.col("k"))).otherwise(loose)
    return checked.select("query_id", key, score.alias("_s")).select(
        "query_id", key, F.round(F.col("_s") / (F.col("_s") + 1), RANK_DIGITS).alias("rank")
    )


def _in_sequence(lines: Column) -> Column:
    """Whether some start position is shared by all steps of a phrase."""
    common = F.aggregate(lines, F.try_element_at(lines, F.lit(1)), F.array_intersect)
    return F.coalesce(F.size(common) > 0, F.lit(False))


def _weight(field: Column, weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for label, w in weights.items():
        out = F.when(field == label, F.lit(float(w))).otherwise(out)
    return out


def _cover_score(events: Column, k: Column) -> Column:
    """Sum over the minimal covers of: mean weight / (1 + positions that are no query term).

    ``events`` are (pos, term number, weight) in position order; a cover ends at an event when every
    term was seen, starts at the oldest last sighting and is minimal when that start moved.
    """
    seen = F.array_repeat(
        F.struct(F.lit(None).cast("int").alias("pos"), F.lit(0.0).alias("w")), k
    )
    zero = F.struct(seen.alias("seen"), F.lit(-1).alias("start"), F.lit(0.0).alias("score"))

    def step(state: Column, e: Column) -> Column:
        now = F.transform(
            state["seen"],
            lambda s, i: F.when(i == e["term"], F.struct(e["pos"].alias("pos"), e["w"].alias("w")))
            .otherwise(s),
        )
        whole = F.forall(now, lambda s: s["pos"].isNotNull())
        start = F.when(whole, F.array_min(F.transform(now, lambda s: s["pos"]))).otherwise(-1)
        total = F.aggregate(now, F.lit(0.0), lambda a, s: a + s["w"])
        gain = F.when(
            start > state["start"], total / k / (F.lit(2.0) + e["pos"] - start - k)
        ).otherwise(0.0)
        return F.struct(
            now.alias("seen"),
            F.greatest(start, state["start"]).alias("start"),
            (state["score"] + gain).alias("score"),
        )

    return F.aggregate(events, zero, step, lambda s: s["score"])
