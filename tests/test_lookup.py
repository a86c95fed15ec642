"""Stored lookup values: ranges of prefixes, the rarest criterion, parts of common values, plans without the record table."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.lookup_index import LookupIndex, criteria, looked_up, lookup_of, rarest_points, read_lookup, words_of, write_lookup
from shelfmark.operators.search import candidates, prepare_queries
from shelfmark.operators.text_index import build_index, match, read_index, with_token, write_index
from shelfmark.operators.workspace import Scratch
from tests.test_search import asked, index, random_criteria, records  # noqa: F401  fixtures


@pytest.fixture(scope="module")
def stored(spark, records, index, tmp_path_factory):  # noqa: F811
    base = str(tmp_path_factory.mktemp("lookup"))
    write_lookup(records, f"{base}/lookup", part=20)
    write_index(index, f"{base}/index", part=20)
    return read_lookup(spark, f"{base}/lookup"), read_index(spark, f"{base}/index")


def test_stored_values_are_those_of_the_records(spark, records, stored):  # noqa: F811
    plain, (lookup, _) = lookup_of(records), stored
    rows = lambda df: sorted(map(tuple, df.select("kind", "value", "md5").collect()))
    assert rows(plain.entries) == rows(lookup.entries)
    counts = lambda df: sorted(map(tuple, df.select("kind", "value", "df").collect()))
    assert counts(plain.vocabulary) == counts(lookup.vocabulary)
    sizes = lookup.entries.groupBy("kind", "value", "part").count().collect()
    common = [r for r in lookup.vocabulary.collect() if r["parts"] > 1]
    assert common and max(r["count"] for r in sizes) < max(r["df"] for r in common)


def test_searches_in_stored_values(spark, records, index, stored):  # noqa: F811
    """With stored values and a stored index the same hits as without."""
    queries = {f"q{n}": c for n in range(40) if (c := random_criteria()) and set(c) != {"exclude"}}
    prepared = prepare_queries(asked(spark, queries)).cache()
    for all_fields in (False, True):
        a = candidates(records, index, prepared, all_fields).select("query_id", "md5", "rank").collect()
        b = candidates(records, stored[1], prepared, all_fields, stored[0]).select("query_id", "md5", "rank").collect()
        assert sorted(a) == sorted(b) and a


def test_ranges_of_prefixes(spark):
    pick = random.Random(3)
    letters = "abcé日\U0001f600"
    words = sorted({"".join(pick.choice(letters) for _ in range(pick.randint(1, 11))) for _ in range(400)})
    prefixes = sorted({w[: pick.randint(1, len(w))] for w in words} | {"zz", "abcabcabcabcabc"})
    vocabulary = spark.createDataFrame([("title", w, 1, 1) for w in words] + [("series", words[0], 1, 1)], "kind string, value string, df long, parts int")
    points = spark.createDataFrame([(p, 0, "title", p, True) for p in prefixes] + [("exact", 0, "title", words[5], False)], "query_id string, criterion int, kind string, value string, by_prefix boolean")
    got = {}
    for r in words_of(points, vocabulary).collect():
        got.setdefault(r["query_id"], []).append(r["value"])
    want = {p: [w for w in words if w.startswith(p)] for p in prefixes} | {"exact": [words[5]]}
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(w) for q, w in want.items() if w}


def test_the_rarest_criterion_is_read(spark, stored):
    queries = {"by isbn": {"language": "deu", "year_from": 1900, "isbn": "9790000000001"}, "by author": {"author": "umit", "title": "h"}, "none": {"language": "deu", "author": "nobody"}}
    prepared = prepare_queries(asked(spark, queries)).cache()
    df = {(r["kind"], r["value"]): r["df"] for r in stored[0].vocabulary.collect()}
    with Scratch(spark) as tmp:
        points = rarest_points(stored[0], prepared, False, tmp).collect()
        every = criteria(prepared).collect()
    assert not [r for r in points if r["query_id"] == "none"]
    chosen = {r["query_id"]: sum(df[x["kind"], x["value"]] for x in points if x["query_id"] == r["query_id"]) for r in points}
    for q, total in chosen.items():
        for number in {r["criterion"] for r in every if r["query_id"] == q}:
            own = [r for r in every if (r["query_id"], r["criterion"]) == (q, number)]
            met = sum(n for (kind, value), n in df.items() if any(kind == r["kind"] and (value.startswith(r["value"]) if r["by_prefix"] else value == r["value"]) for r in own))
            assert total <= met


def test_lookups_do_not_scan_the_records(spark, stored):
    """Only folders of the kinds that are asked for, with the bounds of their values pushed to the scan."""
    prepared = prepare_queries(asked(spark, {"a": {"author": "umit"}, "b": {"language": "swe"}})).cache()
    with Scratch(spark) as tmp:
        hits = looked_up(stored[0], prepared, False, tmp)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert hits.count() > 0
    assert "title_norm" not in plan and "publication_year" not in plan
    scan = next(line for line in plan.splitlines() if "lookup/entries" in line)
    assert re.search(r"PartitionFilters: \[.*kind", scan) and re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(value", scan)


def test_a_common_token_is_dealt_to_many_tasks(spark, folder):
    """Only the query side is repeated, and no task gets more than a bounded share of the entries of a common token."""
    rows = spark.range(4000).select(F.format_string("%032x", "id").alias("md5"), F.array(F.lit("hot"), F.concat(F.lit("w"), "id")).alias("words"))
    write_index(build_index(rows, {"A": F.col("words")}), folder, part=250)
    index = read_index(spark, folder)  # noqa: F811
    assert {r["token"]: r["parts"] for r in index.vocabulary.filter("parts > 1").collect()} == {"hot": 16}
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        queries = spark.createDataFrame([("q1", "hot"), ("q2", "w7")], "query_id string, token string")
        joined = with_token(queries, index.entries, index.vocabulary)
        shares = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(shares) == 4001 and max(shares) < 4000 * 0.3
    terms = spark.createDataFrame([("q", ["hot"]), ("r", ["hot", "w9"])], "query_id string, terms array<string>")
    assert match(index, terms).groupBy("query_id").count().orderBy("query_id").collect() == [("q", 4000), ("r", 1)]


def test_lookup_of_an_empty_table(spark, records, index):  # noqa: F811
    none = records.limit(0)
    prepared = prepare_queries(asked(spark, {"a": {"author": "umit"}})).cache()
    assert candidates(none, index.limit(0), prepared).count() == 0
    assert isinstance(lookup_of(none), LookupIndex)


def test_only_the_rarest_criterion_is_spelt_out(spark):
    """a common beginning next to a rare one costs a count, not a row for each of its words."""
    vocabulary = spark.range(2000).select(F.lit("title").alias("kind"), F.concat(F.lit("a"), "id").alias("value"), F.lit(1).alias("df"), F.lit(1).alias("parts"))
    vocabulary = vocabulary.unionByName(spark.createDataFrame([("title", "zebra", 1, 1)], vocabulary.schema))
    q = prepare_queries(asked(spark, {"q1": {"title": "a ze"}, "q2": {"title": "ze a"}, "q3": {"title": "a ze nothing"}}))
    with Scratch(spark) as tmp:
        points = rarest_points(LookupIndex(None, vocabulary), q, False, tmp)
        assert sorted(map(tuple, points.collect())) == [("q1", "title", "zebra", 1), ("q2", "title", "zebra", 1)]
        assert sum(t.count() for t, _ in tmp.tables) < 20
