"""The registered queries and the stages of the pipeline on the smallest tables."""

import pytest

import corpus_pipeline
from shelfmark.llm import packing, pii
from shelfmark.llm.queries import ORACLE, QUERIES
from tests.compare import connection, differences
from tests.llm.test_copies import jaccard_groups

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "pipeline"])
def test_query_returns_a_row_for_each_input(spark, name):
    df = QUERIES[name](spark, FOLDER)
    table = {"op6": "conversations", "op9": "pages", "op12": "embeddings", "op13": "embeddings"}.get(name.split("_")[0], "documents")
    source = spark.read.parquet(f"{FOLDER}/{table}.parquet")
    rows = df.count()
    if table == "conversations":
        assert rows == source.select("conv_id").distinct().count() + 1
    elif name.startswith("op3"):
        assert df.select("doc_id").distinct().count() == source.count() and rows >= source.count()
    else:
        assert rows == source.count()


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, name):
    _, diff = differences(spark, connection(FOLDER), name, QUERIES[name], ORACLE[name], FOLDER)
    assert not diff


def test_stages(spark):
    """Every stage works on what its predecessor kept and does what it says there."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "pii", "best_fit_packing"]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(corpus_pipeline.written(stage(spark, kept[-1], FOLDER), "stage"))
        assert kept[-1].columns == columns
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in kept]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4]
    groups = {}
    for r in kept[1].collect():
        text = (r["text"] or "").encode().lower()
        groups[text] = max(groups.get(text, r["doc_id"]), r["doc_id"])
    assert ids[2] == set(groups.values())
    rows = [(r["doc_id"], r["text"] or "") for r in kept[2].collect()]
    blank = {i for i, t in rows if not t.split()}
    assert ids[3] == blank | jaccard_groups([r for r in rows if r[0] not in blank])
    assert all(not pii.base_spans(r["text"] or "") for r in kept[4].collect())
    last = corpus_pipeline.STAGES[-1][1](spark, kept[4], FOLDER)
    want = packing.pack_documents(kept[4], corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, last.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    assert {r["doc_id"] for r in last.collect()} == ids[4]


def test_near_copies_of_the_stage_by_definition(spark):
    """What is kept is right by the similarity of the texts themselves, not by fingerprints."""
    docs = corpus_pipeline.written(corpus_pipeline.no_exact_copies(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER), "stage")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    blank = {i for i, t in rows if not t.split()}
    kept = {r["doc_id"] for r in corpus_pipeline.no_near_copies(spark, docs, FOLDER).collect()}
    assert kept == blank | jaccard_groups([r for r in rows if r[0] not in blank])


def test_stages_on_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_run(spark):
    assert QUERIES["pipeline"](spark, FOLDER).count() > 0 and corpus_pipeline.ORACLE_SQL is None
