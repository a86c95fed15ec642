"""Search over a random catalogue against brute force, paging and lookups."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import lookup
from shelfmark.operators.records import RECORD_TYPES, quality_score, record_columns, with_derived
from shelfmark.operators.search import candidates, next_keys, page, prepare_queries, search
from shelfmark.operators.text_index import build_index, match
from shelfmark.plans.imports import index_records

RNG = random.Random(20)
TITLE_WORDS = ["harbour", "harp", "mill", "milling", "granite", "lantern", "tide", "tidal", "öre", "ledger"]
PEOPLE = ["Ines Tallow", "Bo Quarrel", "Ümit Serin", "Harper Mill", "Tide Lanternman"]
PRESSES = ["Quay & Sons", "Granite House", "Tidal Press", None]


def ean(stem):
    return stem + str(-sum(int(c) * (1, 3)[i % 2] for i, c in enumerate(stem)) % 10)


def a_book(n):
    return {
        "md5": f"{n:032x}",
        "title": " ".join(RNG.choices(TITLE_WORDS, k=RNG.randrange(1, 5))),
        "authors": RNG.sample(PEOPLE, RNG.randrange(1, 3)),
        "publisher": RNG.choice(PRESSES),
        "year": RNG.choice([None, *range(1950, 1956)]),
        "language": RNG.choice(["deu", "eng", "swe"]),
        "extension": RNG.choice(["djvu", "mobi", "txt"]),
        "isbn": RNG.choice([None, ean(f"97900{RNG.randrange(4):07d}")]),
        "series": RNG.choice([None, "Harbour Lights", "Tidal Notes"]),
        "position": RNG.choice([None, 1, 2, 3]),
        "deleted": RNG.random() < 0.15,
    }


BOOKS = [a_book(n) for n in range(70)]


def words(text):
    return (text or "").lower().replace("ö", "o").replace("ü", "u").replace("&", " ").split()


def fields_of(book):
    people = [w for a in book["authors"] for w in words(a)]
    return words(book["title"]), people, words(book["publisher"])


def fits(book, c, all_fields=False):
    """The criteria by definition."""
    title, people, press = fields_of(book)
    every = title + people + press
    starts = lambda prefixes, among: all(any(w.startswith(p) for w in among) for p in words(prefixes))
    run = words(c.get("phrase"))
    in_a_row = any(every[i : i + len(run)] == run for i in range(len(every)))  # fields follow each other
    return (
        not book["deleted"]
        and set(words(c.get("q"))) <= set(every)
        and (not run or in_a_row)
        and (not c.get("any_of") or bool(set(words(c["any_of"])) & set(every)))
        and not set(words(c.get("exclude"))) & set(every)
        and set(words(c.get("author"))) <= set(people)
        and starts(c.get("title"), every if all_fields else title)
        and starts(c.get("series"), words(book["series"]))
        and c.get("isbn") in (None, book["isbn"])
        and ("language" not in c or c["language"] == book["language"])
        and ("extension" not in c or c["extension"].lower() == book["extension"])
        and c.get("series_position") in (None, book["position"])
        and ("year_from" not in c or (book["year"] or 0) >= c["year_from"])
        and ("year_to" not in c or (book["year"] or 9999) <= c["year_to"])
    )


@pytest.fixture(scope="module")
def records(spark):
    df = spark.createDataFrame(
        [tuple(b.values()) for b in BOOKS],
        "md5 string, title string, authors array<string>, publisher string, year int, language string,"
        " extension string, isbn string, series string, position int, deleted boolean",
    )
    c = F.col
    rows = df.select(*record_columns(
        md5=c("md5"), title=c("title"), authors=c("authors"), publisher=c("publisher"), publication_year=c("year"),
        languages=F.array("language"), extension=c("extension"), isbn13=F.filter(F.array("isbn"), lambda v: v.isNotNull()),
        series_name=c("series"), series_position=c("position"), deleted=c("deleted"),
        source_collection=F.lit("libby_records"), source_record_id=F.right("md5", F.lit(2)),
    ))
    out = with_derived(rows.withColumn("quality_score", quality_score()), score=False).cache()
    assert set(RECORD_TYPES) <= set(out.columns)
    return out


@pytest.fixture(scope="module")
def index(records):
    return index_records(records).cache()


KINDS = {
    "q": "string", "phrase": "string", "any_of": "string", "exclude": "string", "title": "string", "author": "string",
    "isbn": "string", "language": "string", "series": "string", "series_position": "int", "extension": "string",
    "year_from": "int", "year_to": "int", "page_size": "int", "after_rank": "double", "after_md5": "string",
}


def asked(spark, queries):
    rows = [(name, *(c.get(k) for k in KINDS)) for name, c in queries.items()]
    return spark.createDataFrame(rows, "query_id string, " + ", ".join(f"{k} {t}" for k, t in KINDS.items()))


def random_criteria():
    makers = {
        "q": lambda: " ".join(RNG.sample(TITLE_WORDS + ["quarrel", "press"], RNG.randrange(1, 3))),
        "phrase": lambda: " ".join(RNG.choices(TITLE_WORDS, k=2)),
        "any_of": lambda: " ".join(RNG.sample(TITLE_WORDS, 3)),
        "author": lambda: RNG.choice(["tallow", "serin umit", "bo", "mill harper"]),
        "title": lambda: " ".join(RNG.sample(["har", "mi", "ti", "l", "gran"], RNG.randrange(1, 3))),
        "series": lambda: RNG.choice(["har li", "tid", "notes"]),
        "isbn": lambda: RNG.choice(BOOKS)["isbn"],
        "language": lambda: RNG.choice(["deu", "swe"]),
        "extension": lambda: RNG.choice(["TXT", "mobi"]),
        "series_position": lambda: RNG.randrange(1, 4),
        "year_from": lambda: RNG.randrange(1950, 1954),
        "year_to": lambda: RNG.randrange(1953, 1956),
    }
    chosen = RNG.sample(sorted(makers), RNG.randrange(1, 4))
    out = {k: makers[k]() for k in chosen}
    if RNG.random() < 0.3:
        out["exclude"] = RNG.choice(TITLE_WORDS)
    return {k: v for k, v in out.items() if v is not None and (k != "exclude" or len(out) > 1)}


@pytest.mark.parametrize("all_fields", [False, True])
def test_random_criteria(spark, records, index, all_fields):
    queries = {f"q{n}": c for n in range(60) if (c := random_criteria()) and set(c) != {"exclude"}}
    queries |= {"author first": {"title": "ser har"}, "press first": {"title": "quay ti"}, "only press": {"title": "hous"}}
    sized = {n: c | {"page_size": 100} for n, c in queries.items()}
    got = {n: set() for n in queries}
    for r in search(records, index, asked(spark, sized), all_fields).collect():
        assert r["md5"] not in got[r["query_id"]]
        got[r["query_id"]].add(r["md5"])
    for n, c in queries.items():
        assert got[n] == {b["md5"] for b in BOOKS if fits(b, c, all_fields)}, (n, c)
    assert sum(map(bool, got.values())) > 20


def test_a_word_counts_most_in_the_title(spark, records, index):
    """One hit each: a title word ranks before an author's, that before the publisher's."""
    rows = search(records, index, asked(spark, {"q": {"q": "mill", "page_size": 100}})).orderBy("place").collect()
    by_key = {b["md5"]: fields_of(b) for b in BOOKS}
    where = [[f.count("mill") for f in by_key[r["md5"]]] for r in rows]
    alone = [c.index(1) for c in where if sum(c) == 1]
    assert alone == sorted(alone) and len(set(alone)) > 1


@pytest.mark.parametrize("size", [1, 4, 7])
def test_pages_add_up(spark, records, index, size):
    given, seen = {"author": "tallow", "page_size": size}, []
    while True:
        rows = search(records, index, asked(spark, {"q": given})).cache()
        seen += [r["md5"] for r in rows.orderBy("place").collect()]
        key = next_keys(rows).first()
        if key is None or key["after_md5"] is None:
            break
        given |= {"after_rank": key["after_rank"], "after_md5": key["after_md5"]}
    assert seen == sorted(b["md5"] for b in BOOKS if fits(b, {"author": "tallow"}))


def test_editions_are_counted_within_a_query(spark, records, index):
    rows = search(records, index, asked(spark, {"q": {"language": "eng", "page_size": 100}})).collect()
    works = {r["md5"]: r["work_key"] for r in records.collect()}
    live = [works[b["md5"]] for b in BOOKS if fits(b, {"language": "eng"})]
    assert len(rows) == len(live)
    for r in rows:
        key = works[r["md5"]]
        assert r["edition_count"] == (live.count(key) if key else None)


def test_page_is_as_long_as_asked(spark):
    """Sizes beyond the bound of requests too, when the page is taken of rows directly."""
    rows = spark.range(330).select(F.lit("q").alias("query_id"), F.lit(0.5).alias("rank"), F.format_string("%05d", "id").alias("md5"))
    for size in (1, 150, 329, 330):
        got = page(rows, spark.createDataFrame([("q", size)], "query_id string, page_size int")).orderBy("place").collect()
        assert [r["md5"] for r in got] == [f"{i:05d}" for i in range(size)]
        assert all(r["has_next"] == (size < 330) for r in got)


def cover_rank(places, terms):
    """Minimal covers by trying all intervals."""
    points = sorted((p, t) for t in terms for p in places.get(t, []))
    spans = []
    for i, (start, _) in enumerate(points):
        need = set(terms)
        for end, t in points[i:]:
            need.discard(t)
            if not need:
                spans.append((start, end))
                break
    minimal = [s for s in spans if not any(o != s and o[0] >= s[0] and o[1] <= s[1] for o in spans)]
    score = sum(1.0 / (end - start + 2 - len(terms)) for start, end in set(minimal))
    return round(score / (score + 1), 9)


def test_match_and_rank_by_brute_force(spark):
    rng = random.Random(4)
    words = list("abcdefg")
    docs = {f"d{i}": [rng.choice(words) for _ in range(rng.randrange(1, 25))] for i in range(60)}
    queries = {}
    for i in range(25):
        queries[f"q{i}"] = dict(
            terms=rng.sample(words, rng.randrange(0, 4)), any_of=rng.sample(words, rng.randrange(0, 3)),
            exclude=rng.sample(words, rng.randrange(0, 2)),
            phrase=[rng.choice(words) for _ in range(rng.choice([0, 0, 2, 3]))],
        )
    df = spark.createDataFrame(list(docs.items()), "md5 string, w array<string>")
    index = build_index(df, {"A": F.col("w")})
    q = spark.createDataFrame(
        [(k, v["terms"], v["any_of"], v["exclude"], v["phrase"]) for k, v in queries.items()],
        "query_id string, terms array<string>, any_of array<string>, exclude array<string>, phrase array<string>",
    )
    got = {(r["query_id"], r["md5"]): r["rank"] for r in match(index, q).collect()}
    expected = {}
    for qid, v in queries.items():
        terms = list(dict.fromkeys(v["terms"] + v["phrase"]))
        for d, w in docs.items():
            if not terms and not v["any_of"]:
                continue
            n = len(v["phrase"])
            ok = set(terms) <= set(w) and not set(v["exclude"]) & set(w)
            ok = ok and (not v["any_of"] or bool(set(v["any_of"]) & set(w)))
            ok = ok and (n == 0 or any(w[i : i + n] == v["phrase"] for i in range(len(w))))
            if ok:
                places = {t: [i for i, x in enumerate(w) if x == t] for t in set(w)}
                if terms:
                    expected[qid, d] = cover_rank(places, terms)
                else:
                    s = float(sum(len(places.get(t, [])) for t in v["any_of"]))
                    expected[qid, d] = round(s / (s + 1), 9)
    assert got.keys() == expected.keys()
    for k in got:
        assert abs(got[k] - expected[k]) < 1e-8, (k, got[k], expected[k])


INVALID = {
    "no word": ({"q": "!!! --", "author": "bo"}, "q without a word"),
    "page of none": ({"q": "mill", "page_size": 0}, "invalid page_size"),
    "page too long": ({"q": "mill", "page_size": 101}, "invalid page_size"),
    "year too early": ({"year_from": 999}, "invalid year"),
    "year too late": ({"year_to": 2101}, "invalid year"),
    "years turned": ({"year_from": 1990, "year_to": 1989}, "year_from after year_to"),
    "position": ({"series_position": 10_000}, "invalid series_position"),
    "isbn": ({"isbn": ean("979000000000")[:-1] + "x"}, "invalid isbn"),
    "language": ({"language": "klingonish"}, "invalid language"),
    "extension": ({"extension": "tar gz"}, "invalid extension"),
    "only excluded": ({"exclude": "mill"}, "no criterion"),
    "blank": ({"q": " ", "title": ""}, "no criterion"),
    "bounds": ({"year_from": 1000, "year_to": 2100, "page_size": 100, "series_position": 9999}, None),
    "single": ({"author": "bo", "page_size": 1}, None),
}


def test_validation(spark, records, index):
    raw = asked(spark, {n: c for n, (c, _) in INVALID.items()})
    got = {r["query_id"]: r["invalid_reason"] for r in prepare_queries(raw).collect()}
    assert got == {n: reason for n, (_, reason) in INVALID.items()}
    answered = {r["query_id"] for r in search(records, index, raw).select("query_id").distinct().collect()}
    assert answered <= {n for n, (_, reason) in INVALID.items() if reason is None}


def test_lookups(spark, records):
    live, gone = (next(b["md5"] for b in BOOKS if b["deleted"] is d) for d in (False, True))
    keys = {live.upper(): "ok", gone: "removed", "f" * 32: "missing", "no key": "invalid"}
    found = lookup.by_key(records, spark.createDataFrame([(k,) for k in keys], "md5 string"))
    assert {r["asked"]: r["status"] for r in found.collect()} == keys
    refs = {r["asked"]: r["source_record_id"] for r in lookup.source_references(found).collect()}
    assert refs == {live.upper(): live[-2:], gone: None, "f" * 32: None, "no key": None}
    isbn = next(b["isbn"] for b in BOOKS if b["isbn"] and not b["deleted"])
    works = spark.createDataFrame([(f" isbn:{isbn} ",), ("title:none",)], "work_key string")
    rows = lookup.best_first(lookup.editions(records, works)).collect()
    want = {b["md5"] for b in BOOKS if b["isbn"] == isbn and not b["deleted"]}
    assert {r["md5"] for r in rows} == want and {r["total_editions"] for r in rows} == {len(want)}
    answer = lookup.response(records.filter(F.col("md5") == live)).first()
    assert answer["source"]["record_id"] == live[-2:]


def test_a_catalogue_makes_what_is_asked_for(spark, tmp_path):
    """A lookup by key writes no index, a search by fields none of the text."""
    import os

    from shelfmark.plans.queries import QUERIES
    from shelfmark.plans.queries.searching import stored_catalogue

    for name in ("documents", "labels", "benchmark"):
        os.symlink(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    folder = str(tmp_path)
    made = lambda: {"records", "index", "lookup"} & set(vars(stored_catalogue(spark, folder)))
    for query, parts in (("key_lookup", {"records"}), ("search_filters", {"records", "lookup"}), ("search_match", {"records", "lookup", "index"})):
        QUERIES[query](spark, folder)
        assert made() == parts


def test_places_are_sorted_natively(spark, records):
    """no interpreted comparison for each pair of words."""
    plan = build_index(records, {"A": F.split("title_norm", " ")})._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan


def test_titles_are_taken_apart_once_for_each_record(spark, records):
    """the words are worked out below the join with the hits, and not at all when no query looks at titles."""
    from shelfmark.operators.search import _hit_records

    hits = records.select("md5").limit(3).withColumn("query_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    got = _hit_records(records, hits, True, False)
    assert got.count() == 3 and got.filter(F.size("title_words") > 0).count() > 0
    assert _hit_records(records, hits, False, False).filter(F.size("title_words") > 0).isEmpty()


def test_texts_are_found_without_an_index_as_with_one(spark, records):
    """Pairs and ranks are those of an index of all words; entries are made for the asked words of hit records only."""
    from shelfmark.operators.text_index import Unindexed
    from shelfmark.plans.imports import index_fields, unindexed_records

    asked = [
        ("all", ["harbour", "mill"], [], [], []),
        ("row", ["tide"], [], [], ["mill", "tide"]),
        ("any", [], ["granite", "serin"], ["press"], []),
        ("across", ["tallow", "quay", "tide"], [], [], []),
        ("none", ["harbour", "absent"], [], [], []),
    ]
    queries = spark.createDataFrame(asked, "query_id string, terms array<string>, any_of array<string>, exclude array<string>, phrase array<string>")
    rows = lambda index: sorted(map(tuple, match(index, queries).select("query_id", "md5", "rank").collect()))
    want = rows(index_records(records))
    assert {r[0] for r in want} >= {"all", "any"} and rows(unindexed_records(records)) == want

    one = records.filter(~F.col("deleted")).limit(1).withColumn("title_norm", F.lit("tide mill of the tide"))
    wanted = one.select("md5", F.lit("tide").alias("token"))
    got = Unindexed(one, index_fields()).entries(wanted).collect()
    assert [(r["token"], [p["pos"] for p in r["places"]]) for r in got] == [("tide", [0, 4])]


def test_a_table_of_many_files_is_not_shuffled_to_spread_it(spark, tmp_path):
    """Whole texts are moved only where there are fewer files than cores."""
    from shelfmark.plans.queries.registry import spread

    cores = spark.sparkContext.defaultParallelism
    for files in (1, cores):
        spark.range(100 * cores).repartition(files).write.parquet(f"{tmp_path}/{files}")
    plan = lambda n: spread(spark.read.parquet(f"{tmp_path}/{n}"))._jdf.queryExecution().toString()
    assert "Repartition" in plan(1) and "Repartition" not in plan(cores)


def test_lookups_store_no_texts(spark):
    """the record table they make has no titles; with them it is the merged record table."""
    from shelfmark.plans.queries import QUERIES
    from shelfmark.plans.queries.searching import Catalogue, catalogue, stored_catalogue

    folder = "/root/testdata/sf0.001"
    for query in ("key_lookup", "editions_by_work"):
        QUERIES[query](spark, folder)
    assert not {"title", "title_norm"} & set(stored_catalogue(spark, folder).records.columns)
    whole, stored = catalogue(spark, folder), Catalogue(spark, folder).titled
    assert sorted(whole.columns) == sorted(stored.columns)
    rows = lambda df: sorted(map(str, df.select(*whole.columns).collect()))
    assert rows(whole) == rows(stored)


def test_asked_entries_are_those_of_the_whole_index(spark, records):
    """of the words that nobody asks for no struct is made; places and fields are those of the index of all words."""
    from shelfmark.plans.imports import unindexed_records

    whole = index_records(records)
    wanted = whole.filter(F.col("token").isin("tide", "mill", "press", "granite", "serin", "the")).select("md5", "token")
    got = unindexed_records(records).entries(wanted)
    rows = lambda df: sorted(map(str, df.select("token", "md5", "places").collect()))
    want = rows(whole.join(wanted, ["md5", "token"]))
    assert len({f for f in "ABC" for r in want if f"field='{f}'" in r}) > 1 and rows(got) == want
    assert "filter(transform(concat(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_taken_without_a_group(spark):
    """a group would be tracked for each word."""
    from shelfmark.functions.text import tokens

    df = spark.createDataFrame([("a_1, Éa-b\u0301 ?",), ("",), (None,)], "t string").select(tokens(F.col("t")).alias("w"))
    assert [r["w"] for r in df.collect()] == [["a_1", "Éa", "b"], [], None]
    assert "([" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_the_record_table_moves_no_texts(spark):
    """no text is in an exchange on the way to the record table, be the labels too large to broadcast and the documents one file;
    one is for the titles."""
    import re

    from shelfmark.plans.queries.searching import document_texts, titled, untitled

    folder, name = "/root/testdata/sf0.001", "spark.sql.autoBroadcastJoinThreshold"

    def moved(df):
        plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)

    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        records = untitled(spark, folder)
        texts = [bool(re.search(r"\b(text|title)#", columns)) for columns in moved(records)]
        assert len(texts) >= 3 and not any(texts)
        texts = [bool(re.search(r"\b(text|title)#", columns)) for columns in moved(titled(records, document_texts(spark, folder)))]
        assert texts.count(True) == 1
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("hot_rows", [10_000, 3])
def test_records_of_odd_texts_are_those_of_the_whole_rows(spark, tmp_path, hot_rows):
    """null and empty texts, copies and missing labels: scores, titles and the other columns are those worked out from whole rows."""
    from shelfmark.operators.merge import merge_versions
    from shelfmark.operators.records import without_title
    from shelfmark.plans.queries.searching import SPEC, document_texts, document_versions, titled

    texts = [None, "", "", "of 1876", "of 1876", "of 1876", "of 1876", "of 1876", "x" * 500, "in 9999", " "]
    docs = [(i, t, "en" if i % 2 else "de", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, i % 2, 1 if i in (2, 9) else 0) for i in range(0, 11, 2)] + [(9, None, None)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    versions, read = document_versions(spark, str(tmp_path)), document_texts(spark, str(tmp_path))
    assert versions.filter(versions.quality_score != quality_score()).isEmpty() and versions.count() == len(texts)
    whole = with_derived(merge_versions(versions, hot_rows=hot_rows), score=False)
    late = titled(without_title(merge_versions(versions, SPEC, hot_rows, read), score=False), read)
    rows = lambda df: sorted(map(str, df.select(*whole.columns).collect()))
    assert rows(late) == rows(whole) and len(rows(whole)) == 5


def test_searches_by_fields_store_no_titles(spark, tmp_path):
    """a search by other fields fetches no title, one by titles stores them once, as they are searched, and no entries of their words."""
    import os

    from shelfmark.plans.queries import QUERIES
    from shelfmark.plans.queries.searching import stored_catalogue

    for name in ("documents", "labels", "benchmark"):
        os.symlink(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    made = lambda: {"titled", "searchable", "lookup", "words"} & set(vars(stored_catalogue(spark, str(tmp_path))))
    QUERIES["search_prefix"](spark, str(tmp_path))
    assert made() == {"searchable", "words"}
    stored = stored_catalogue(spark, str(tmp_path))
    assert "title" not in stored.searchable.columns and not [f for f in stored.words.entries.inputFiles() if "/searchable-" not in f]
    QUERIES["search_prefix_all_fields"](spark, str(tmp_path))
    assert made() == {"searchable", "words"}
    vars(stored).pop("searchable"), vars(stored).pop("words")
    QUERIES["search_filters"](spark, str(tmp_path))
    assert made() == {"lookup"} and "title" not in {r["kind"] for r in stored.lookup.vocabulary.select("kind").distinct().collect()}


def test_what_is_not_looked_up_is_not_answered(spark, records):
    """values of only some kinds, and no index: a query that needs more fails, others have the same rows."""
    from shelfmark.operators.lookup_index import KINDS, lookup_of

    some = lookup_of(records, kinds=tuple(k for k in KINDS if k != "title"))
    queries = lambda **criteria: prepare_queries(asked(spark, {"q": criteria}))
    by_author = queries(author="umit")
    rows = lambda *args: sorted(map(tuple, candidates(records, *args).select("query_id", "md5").collect()))
    assert rows(None, by_author, False, some) == rows(index_records(records), by_author) != []
    assert rows(None, queries(page_size=0, author="umit").filter("invalid_reason is null"), False, some) == []
    with pytest.raises(ValueError, match="kind of value"):
        candidates(records, None, queries(title="tide"), False, some)
    for criteria in ({"q": "tide"}, {"author": "umit", "exclude": "tide"}):
        with pytest.raises(ValueError, match="no index"):
            candidates(records, None, queries(**criteria), False, some)


def test_many_hits_move_no_titles(spark, records, monkeypatch):
    """words are made below the join with the hits, and only those that may begin as asked; few or many, the rows are the same."""
    import re

    import shelfmark.operators.search as s

    asks = {f"q{n}": {"title": t} for n, t in enumerate(("har", "t mil", "ti", "ö led", "quay", "mill tida", "granite s", "日"))}
    prepared = prepare_queries(asked(spark, asks))
    rows = lambda every: sorted(map(tuple, candidates(records, None, prepared, every).select("query_id", "md5").collect()))
    few = [rows(False), rows(True)]
    hits = records.select("md5").withColumn("query_id", F.lit("q"))
    monkeypatch.setattr(s, "FEW", 0)
    assert [rows(False), rows(True)] == few and all(few)
    monkeypatch.setattr(s, "BEGINNINGS", 2)
    assert [rows(False), rows(True)] == few
    monkeypatch.setattr(s, "BEGINNINGS", 1_000)
    held = s._hit_records(records, hits, True, True, prepared).select("md5", "title_words")
    words = {w for r in held.collect() for w in r["title_words"]}
    assert words and all(re.match("ha|t|mi|ti|o|le|qu|gr|s|日", w) for w in words)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = hits.join(held, "md5")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert any("title_words" in m for m in moved) and not any("title_norm" in m for m in moved)


def test_a_segment_moves_no_entries(spark, records, tmp_path):
    """the entries of a record stay with the task that read it, sorted by token; the newest segment is not joined with what it overrules."""
    import re

    from shelfmark.operators.text_index import read_index, write_index
    from shelfmark.plans.imports import refresh_index

    records.repartition(3).write.parquet(f"{tmp_path}/records")
    stored, path = spark.read.parquet(f"{tmp_path}/records"), f"{tmp_path}/index"
    write_index(index_records(stored), path)
    entries = spark.read.parquet(f"{path}/entries/segment=1").withColumn("file", F.col("_metadata.file_path"))
    files = {}
    for r in entries.select("file", F.col("_metadata.row_index").alias("n"), "token", "part", "md5").collect():
        files.setdefault(r["file"], []).append((r["n"], (r["token"], r["part"], r["md5"])))
    assert len(files) == 3 == len({f for f in stored.inputFiles()})
    ordered = [[e for _, e in sorted(rows)] for rows in files.values()]
    assert all(rows == sorted(rows) for rows in ordered)
    assert sum(len({e[2] for e in rows}) for rows in ordered) == entries.select("md5").distinct().count()

    refresh_index(spark, path, stored.filter("md5 like '%1'").withColumn("title_norm", F.lit("newest words")))
    index = read_index(spark, path)
    rows = lambda i: sorted(map(str, i.rows().collect()))
    assert rows(index) == rows(index._replace(newest=None)) and index.newest == 2
    plan = index.rows()._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"NOT \(segment#\d+ = 2\)|segment#\d+ != 2", plan)
