"""Adapters, line files, manifests, imports and streams on lines written here."""

import gzip
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.discards import check_error_rate, discard_samples, import_counters, quarantine
from shelfmark.operators.tables import kept_rows, purge
from shelfmark.operators.text_index import compacted, match, read_index, write_index
from shelfmark.plans.imports import import_release, index_records, refresh_index
from shelfmark.sources import adapters as ad
from shelfmark.sources.jsonl import list_files, read_lines, unread_files
from shelfmark.sources.manifest import latest_releases, pinned_release, read_manifest, releases
from shelfmark.streaming.imports import fold_staged, stage_stream, staged_counters


def envelope(aacid, meta):
    return json.dumps({"aacid": aacid, "metadata": meta})


def parsed(spark, collection, lines, settings=ad.AdapterSettings()):
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, line string")
    return ad.adapt(df, collection, settings)


def rows(df):
    return [r.asDict() for r in df.orderBy("seq", "part").collect()]


STAMP = "aacid__zlib3_records__20240102T030405Z__{}__x"


def book(n, **meta):
    base = {"md5_reported": f"{n:032x}", "zlibrary_id": n, "title": f"Book {n}", "author": "Ann Lee"}
    return envelope(STAMP.format(n), {**base, **meta})


def test_fallbacks_and_odd_shapes(spark):
    lines = [
        book(1, title=["", " A list "], publisher="[Town] : House", year="", removed=1, removalReason="asked",
             annabookinfo={"response": {"year": "2005", "filesize": "77", "extension": "EPUB", "ipfs_cid": "Qm"}}),
        book(2, annabookinfo=[], volume="40000", language=["", "german"]),
        "{broken", "42", envelope("x", []), envelope("x", {"md5_reported": "no"}), "{}",
    ]
    got = rows(parsed(spark, ad.ZLIB3, lines))
    assert [r["outcome"] for r in got] == ["kept", "kept", "failed", "failed", "failed", "skipped", "skipped"]
    first = got[0]
    assert (first["title"], first["publisher"], first["publication_year"], first["extension"]) == (
        "A list", "[Town] : House", 2005, "epub",
    )
    assert (first["filesize"], first["deleted"], first["removed_reason"], first["ipfs_cid"]) == (77, True, "asked", "Qm")
    assert (got[1]["languages"], got[1]["series_position"], got[1]["deleted"]) == (["deu"], None, False)
    assert got[2]["error"].endswith(":: {broken")


def test_kept_record_without_a_title(spark):
    """Its title is empty, not null; lines that are not kept have none."""
    lines = [book(1, title=" "), book(2, title=[]), book(3, title=None), book(4, md5_reported="no")]
    got = rows(parsed(spark, ad.ZLIB3, lines))
    assert [(r["outcome"], r["title"]) for r in got] == [("kept", "")] * 3 + [("skipped", None)]
    volume = envelope("x", {"id": "v", "printType": "BOOK"})
    assert [(r["outcome"], r["title"]) for r in rows(parsed(spark, ad.GBOOKS, [volume]))] == [("kept", "")]


def test_item_with_repeated_and_bad_files(spark):
    files = [{"md5": "a" * 32, "name": "x.b.PDF", "size": "5"}, {"md5": "A" * 32, "name": "y"}, "odd",
             {"md5": "zz"}, {"md5": "b" * 32, "size": "n/a"}]
    item = {"ia_id": "i", "metadata_json": {"metadata": {"title": "T"}, "aa_shorter_files": files}}
    got = rows(parsed(spark, ad.IA2, [envelope("x", item)]))
    assert [(r["md5"][0], r["extension"], r["filesize"], r["part"]) for r in got] == [
        ("a", "pdf", 5, 0), ("b", None, None, 1),
    ]


def test_gates_can_be_switched_off(spark):
    audio = {"ia_id": "i", "metadata_json": {"metadata": {"mediatype": ["Audio"]}, "aa_shorter_files": [{"md5": "a" * 32}]}}
    strict = rows(parsed(spark, ad.IA2, [envelope("x", audio)]))[0]
    assert (strict["outcome"], strict["discard_reason"]) == ("discarded", "ia_mediatype:audio")
    loose = ad.AdapterSettings(
        require_ia_texts=False, require_gbooks_books=False, require_upload_title_author=False,
        blocked_upload_groups=(), libby_types=("ebook",),
    )
    assert rows(parsed(spark, ad.IA2, [envelope("x", audio)], loose))[0]["outcome"] == "kept"
    magazine = envelope("x", {"id": "m", "printType": "MAGAZINE", "title": "M"})
    assert rows(parsed(spark, ad.GBOOKS, [magazine]))[0]["discard_reason"] == "gbooks_printtype:MAGAZINE"
    assert rows(parsed(spark, ad.GBOOKS, [magazine], loose))[0]["title"] == "M"
    audiobook = envelope("x", {"id": "1", "type": {"id": "audiobook"}})
    assert rows(parsed(spark, ad.LIBBY, [audiobook]))[0]["outcome"] == "kept"
    assert rows(parsed(spark, ad.LIBBY, [audiobook], loose))[0]["discard_reason"] == "libby_type:audiobook"
    upload = envelope("aacid__upload_records_magzdb__20240102T030405Z__1__x",
                      {"md5": "c" * 32, "filepath": "d/Some_File.epub"})
    assert rows(parsed(spark, ad.UPLOADS, [upload]))[0]["discard_reason"] == "blocked_subcollection:magzdb"
    assert rows(parsed(spark, ad.UPLOADS, [upload], loose))[0]["title"] == "Some File"


def test_xml_records(spark):
    good = "<r><book><title>T</title><work><original_publication_year>1927</original_publication_year></work>" \
           "<authors><author><name>N; M</name></author></authors></book></r>"
    lines = [envelope("x", {"id": i, "record": x}) for i, x in enumerate([good, "<r><book>", "", "<r/>"])]
    got = rows(parsed(spark, ad.GOODREADS, [*lines, envelope("x", {"record": good})]))
    assert [r["outcome"] for r in got] == ["kept", "failed", "failed", "failed", "skipped"]
    assert (got[0]["publication_year"], got[0]["authors"]) == (1927, ["N", "M"])


def test_unknown_collection(spark):
    with pytest.raises(KeyError):
        parsed(spark, "nothing", ["{}"])
    df = spark.createDataFrame([("nothing", 1, "{}"), (ad.ZLIB3, 2, book(1))], "collection string, seq long, line string")
    got = {r["seq"]: r["outcome"] for r in ad.adapt_mixed(df).collect()}
    assert got == {1: "failed", 2: "kept"}


def test_mixed_lines_in_one_pass(spark, folder):
    """A single scan; every line has the outcome that the adapter of its collection alone gives it."""
    item = {"ia_id": "i", "metadata_json": {"metadata": {"title": "T"}, "aa_shorter_files": [{"md5": "a" * 32, "name": "x.PDF"}, {"md5": "b" * 32}]}}
    lines = [
        (ad.ZLIB3, book(1)), (ad.ZLIB3, "{bad"), (ad.ZLIB3, "{}"), (ad.IA2, envelope("x", item)), (ad.IA2, "[]"), (ad.IA2, envelope("x", {})),
        (ad.UPLOADS, envelope("x", {"md5": "c" * 32, "filepath": "d/Some_File.epub"})), (ad.GOODREADS, envelope("x", {"id": 1, "record": "<r><book>"})),
        (ad.GBOOKS, envelope("x", {"id": "m", "printType": "MAGAZINE"})), (ad.LIBBY, envelope("x", {"id": "1", "title": "L", "languages": ["de"]})),
        ("other", envelope("x", {"id": "1"})), (None, book(2)),
    ]
    df = spark.createDataFrame([(c, n, line) for n, (c, line) in enumerate(lines)], "collection string, seq long, line string")
    df.write.parquet(f"{folder}/mixed")
    mixed = ad.adapt_mixed(spark.read.parquet(f"{folder}/mixed"))
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan|Scan parquet", plan)) == 1 and "Union" not in plan
    generate = next(x for x in plan.splitlines() if "Generate" in x)
    assert "line#" not in generate and "raw#" not in generate  # neither goes through the explode
    got = sorted(map(str, mixed.collect()))
    alone = [r for c in ad.SHAPES for r in ad.adapt(df.filter(F.col("collection") == c), c).collect()]
    strange = mixed.filter(F.col("error").startswith("UnknownCollection")).orderBy("seq").collect()
    assert [(r["seq"], r["error"][:26]) for r in strange] == [(10, "UnknownCollection: other ::"[:26]), (11, "UnknownCollection: none :: "[:26])]
    assert got == sorted(map(str, [*alone, *strange]))


def write(folder, name, lines, compress=False):
    os.makedirs(folder, exist_ok=True)
    data = "\n".join(lines).encode() + b"\n"
    with open(f"{folder}/{name}", "wb") as f:
        f.write(gzip.compress(data) if compress else data)


def test_line_files(spark, folder):
    write(folder, "a.txt", ["one", "", "  two  "])
    write(folder, "b.txt.gz", ["three"], compress=True)
    with open(f"{folder}/c.txt.gz", "wb") as f:
        f.write(b"this is no gzip file")
    lines = read_lines(spark, folder, tolerant=True)
    assert sorted(r["line"] for r in lines.collect()) == ["one", "three", "two"]
    assert lines.select("seq").distinct().count() == 3
    assert [r["file"][-8:] for r in unread_files(list_files(spark, folder), lines).collect()] == ["c.txt.gz"]
    later = read_lines(spark, f"{folder}/a.txt", release_rank=2).agg(F.min("seq")).first()[0]
    assert later > read_lines(spark, folder, tolerant=True).agg(F.max("seq")).first()[0]


def test_manifest(spark, folder):
    name = "annas_archive_meta__aacid__{}__20200101T000000Z--{}T000000Z.jsonl.seekable.zst.torrent"
    entries = [
        {"display_name": name.format("zlib3_records", d), "is_metadata": True, "obsolete": o, "data_size": s}
        for d, o, s in (("20240101", False, 1), ("20240201", False, 2), ("20240301", True, 3))
    ] + [{"display_name": "other", "is_metadata": True}, {"display_name": name.format("ia2_records", "20240101")}]
    write(folder, "m.json", [json.dumps(entries)])
    manifest = read_manifest(spark, f"{folder}/m.json")
    best = latest_releases(releases(manifest)).collect()
    assert [(r["collection"], r["to_stamp"], r["data_size_bytes"]) for r in best] == [
        ("zlib3_records", "20240201T000000Z", 2)
    ]
    assert pinned_release(manifest, "zlib3_records", "20240301T000000Z.jsonl.seekable.zst").count() == 1
    for suffix in ("zst", "nothing"):
        with pytest.raises(ValueError):
            pinned_release(manifest, "zlib3_records", suffix)


def test_import_counts_merge_and_gate(spark, folder):
    lines = [book(n) for n in range(200)] + [book(5, publisher="P", year="2001"), "{bad", "[bad"]
    write(f"{folder}/in", "a.txt", lines)
    result = import_release(spark, f"{folder}/in", ad.ZLIB3)
    assert result.counters == {"seen": 203, "kept": 201, "skipped": 0, "discarded": 0, "failed": 2}
    assert result.records.count() == 200
    five = result.records.filter(F.col("source_record_id") == "5").first()
    assert (five["publisher"], five["title_norm"], five["author_tokens"]) == ("P", "book 5", ["ann", "lee"])
    again = import_release(spark, f"{folder}/in", ad.ZLIB3, stored=result.records,
                           seen=result.parsed.select("md5", "aacid"), release_rank=2)
    assert sorted(map(str, again.records.collect())) == sorted(map(str, result.records.collect()))
    write(f"{folder}/bad", "a.txt", [book(1), *["{"] * 3])
    with pytest.raises(RuntimeError):
        import_release(spark, f"{folder}/bad", ad.ZLIB3)
    quarantine(result.parsed, f"{folder}/q")
    assert spark.read.parquet(f"{folder}/q").groupBy("reason").count().collect()[0].asDict() == {"reason": "failed", "count": 2}


def test_error_gate():
    def row(seen, failed):
        return {"seen": seen, "failed": failed}

    check_error_rate(row(100, 2))
    check_error_rate(row(100, 50), final=False)
    for bad, final in ((row(0, 0), True), (row(100, 3), True), (row(10_000, 201), False)):
        with pytest.raises(RuntimeError):
            check_error_rate(bad, final=final)


def test_stream_equals_batch_and_replay(spark, folder):
    removed = book(3, removed=1, removalReason="gone").replace("20240102", "20240101")
    for i in range(3):
        write(f"{folder}/in", f"{i}.txt", [book(n, publisher=f"p{i}" if n % 3 == i else "") for n in range(i, 30 + i)])
    write(f"{folder}/in", "3.txt", [removed, book(7, year="1990").replace("20240102", "20250102")])
    base = f"{folder}/base"
    stage_stream(spark, f"{folder}/in", ad.ZLIB3, base, 1, max_files=1).awaitTermination()
    first = fold_staged(spark, base, 1)
    assert staged_counters(spark, base, 1).first()["seen"] == 92
    assert first.count() == 32
    # a second start has nothing new to stage
    stage_stream(spark, f"{folder}/in", ad.ZLIB3, base, 1, max_files=1).awaitTermination()
    assert staged_counters(spark, base, 1).first()["seen"] == 92
    # the next cumulative dump repeats everything and adds one record
    write(f"{folder}/in", "9.txt", [book(99)])
    stage_stream(spark, f"{folder}/in", ad.ZLIB3, base, 2, max_files=10).awaitTermination()
    second = fold_staged(spark, base, 2)
    before = {str(r) for r in first.collect()}
    after = {str(r) for r in second.collect()}
    assert before < after and len(after) == 33


def test_purge(spark, folder):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "source_collection string, n int")
    gone = purge({"records": (df, "source_collection")}, ["a"], f"{folder}/backup", f"{folder}/kept")
    assert gone == {"records": 3}
    assert spark.read.parquet(f"{folder}/kept/records").count() == 1
    assert sorted(r["n"] for r in spark.read.parquet(f"{folder}/backup/records").collect()) == [2, 3, 4]
    with pytest.raises(ValueError):
        kept_rows(df, [])


def test_discard_samples_are_bounded_and_distinct(spark):
    lines = [envelope(f"aacid__upload_records__20240102T030405Z__{i // 2}__x",
                      {"md5": f"{i // 2:032x}", "primary_id": i // 2, "exiftool_output": {"Title": "t" * 300}})
             for i in range(12)]
    got = discard_samples(parsed(spark, ad.UPLOADS, lines).filter("outcome = 'discarded'")).collect()
    assert sorted(r["source_record_id"] for r in got if r["source_record_id"]) == ["1", "2"]
    assert len(got) == 3 and all(len(r["title"]) == 160 for r in got)
    assert import_counters(parsed(spark, ad.UPLOADS, lines)).first()["discarded"] == 12


def test_index_refresh(spark, folder):
    """A refresh adds a segment and leaves the files of the old ones alone; compaction makes one of them."""
    write(f"{folder}/in", "a.txt", [book(1, title="old words"), book(2, title="other"), book(3, title="third old")])
    records = import_release(spark, f"{folder}/in", ad.ZLIB3).records
    path = f"{folder}/index"
    write_index(index_records(records), path)
    before = read_index(spark, path).entries.inputFiles()
    changed = records.filter("source_record_id = '1'").withColumn("title_norm", F.lit("new text"))
    gone = records.filter("source_record_id = '3'").withColumn("deleted", F.lit(True))
    refresh_index(spark, path, changed.unionByName(gone))
    refresh_index(spark, path, changed.withColumn("title_norm", F.lit("newest text")))

    def entries():
        return {(r["token"], r["md5"][-1]) for r in read_index(spark, path).rows().collect()}

    want = {(t, "1") for t in ("newest", "text", "ann", "lee")} | {(t, "2") for t in ("other", "ann", "lee")}
    assert entries() == want
    assert set(before) < set(read_index(spark, path).entries.inputFiles())
    asked = spark.createDataFrame([("a", ["old"]), ("b", ["newest"]), ("c", ["ann"])], "query_id string, terms array<string>")
    hits = {(r["query_id"], r["md5"][-1]) for r in match(read_index(spark, path), asked).collect()}
    assert hits == {("b", "1"), ("c", "1"), ("c", "2")}
    compacted(spark, path)
    assert entries() == want and read_index(spark, path).latest is None
    assert len(read_index(spark, path, version=3).entries.inputFiles()) > len(before)


def test_a_larger_dump_has_more_files_in_the_same_order(spark):
    """No file holds a fixed share of the dump, and the names still give the order of arrival."""
    from shelfmark.plans.queries import dumps

    lines = spark.range(4000).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("line"))
    path = dumps._written_dump(lines, "dump", 16)
    read = [int(r["line"]) for r in read_lines(spark, path).orderBy("seq").collect()]
    file = lambda n: 0 if n % 10 < 1 else 1 if n % 10 < 3 else 2 if n % 10 < 5 else 3
    assert read == sorted(range(4000), key=lambda n: (file(n), n))
    sizes = [r["count"] for r in read_lines(spark, path).groupBy("file").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 4000 / 4
