"""Byte-level BPE, token counts and packing against the public tokenizer libraries."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from shelfmark.llm import bpe, packing, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "", " ", "  ", "a", "word", " lead", "trail ", "a  b", "  a   b \n c  ", "\n\n x", "a\nb\nc d", "\nx", "x\n", "a \n  b",
    "a\n\tb", "foo\t\n\tbar", "a\x1c\x1c b", " \x1cfoo", "n​o 　x", "don't  it's", "1 2  3", "É é ́ ̈x", "\U0001f600",
    "<|endoftext|>", "x<|endoftext|> y<|startoftext|>", "ab" * 3000, "z" * 5000, ("lorem ipsum, dolor\n" * 900),
    "word " * 3000 + "<|endoftext|>", "x" * 400 + " " + "y" * 400,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n") for i, t in enumerate([*TEXTS, None, "word", "word"])]
    return spark.createDataFrame([*rows, (0, "", "again"), (None, "no id", "x")], "doc_id long, text string, id string")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_library(reference):
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for text in TEXTS:
        ids = [i for part in codec.encode(text) for i in part]
        assert ids == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_queue_pops_ranks_in_order():
    queue = bpe.RankQueue(50_256)
    pushed = [50_255, 0, 4096, 64, 63, 64, 5]
    for position, rank in enumerate(pushed):
        queue.push(rank, position)
    popped = []
    while (entry := queue.pop()) is not None:
        popped.append(entry)
    assert popped == [(0, [1]), (5, [6]), (63, [4]), (64, [3, 5]), (4096, [2]), (50_255, [0])]


def test_blocks_do_not_change_ids(reference):
    text = "  two  spaces and words " * 50 + "tail"
    for size in (1, 7, 64):
        parts = list(bpe.blocks(text, size))
        assert "".join(parts) == text and len(parts) > 1
        assert [i for p in parts for i in reference.encode_ordinary(p)] == reference.encode_ordinary(text)


def test_round_trip(spark, docs, reference):
    got = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    assert got.count() == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in got.collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_encode_and_decode_tables(docs):
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = {r["id"]: bytes(r["bytes"]) for r in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}


@pytest.fixture(scope="module")
def words():
    return token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_equal_library(words):
    for text in TEXTS:
        want = len(words.tokenizer.encode(text, add_special_tokens=False).ids)
        assert words.count(text, token_counts.CHUNK, token_counts.OVERLAP) == want
        for chunk, overlap in ((50, 4), (200, 16), (1000, 300)):
            assert token_counts.spliced_count(text, words.spans, chunk, overlap) == want


def test_overlap_is_widened(words):
    text = "abc " * 30 + "q" * 700 + " " + "def " * 50  # no white space for longer than a chunk
    want = len(words.tokenizer.encode(text, add_special_tokens=False).ids)
    assert token_counts.spliced_count(text, words.spans, 100, 10) == want


def test_token_counts(docs, words):
    got = {}
    for r in token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), limit=100).collect():
        got[r["doc_id"]] = (r["n_bytes"], r["n_tokens"], r["over_limit"])
    for r in docs.collect():
        text = r["text"] or ""
        n = len(words.tokenizer.encode(text, add_special_tokens=False).ids)
        assert got[r["doc_id"]] == (len(text.encode()), n, n > 100)


def test_encoder_equals_library():
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder.ranked is not None
    for text in TEXTS:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.ids(text)
    encoder.ranked = None
    assert all(np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.ids(text) for text in TEXTS)


def checked(rows, capacity):
    """Sequences are gapless and hold at most capacity; returns how many there are."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(sequences)


def test_pack_documents(docs):
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=512).collect()
    checked(rows, 512)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], set()).add((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for r in docs.collect():
        ids = np.frombuffer(encoder.encode(r["text"] or ""), "<u4").tolist() + [0]
        first = len(ids) if len(ids) <= 512 else len(ids) % 512 or 512
        cuts = [0, *range(first, len(ids) + 1, 512)]
        want = {
            (p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))
        }
        assert by_doc[r["doc_id"]] == want


def test_tree_of_levels(spark):
    """Many partitions of few pieces: nothing fills a bin locally, all are joined up the tree."""
    sizes = [(i, 0, 0, 1 + (i * 37) % 60, i) for i in range(3000)]
    pieces = spark.createDataFrame(sizes, "id long, piece int, start long, length long, crc long").repartition(200)
    rows = packing.pack(pieces, capacity=1000, nearly=0, fan_in=4).collect()
    assert sorted(r["id"] for r in rows) == list(range(3000))
    total = sum(s[3] for s in sizes)
    assert checked(rows, 1000) <= 1.15 * total / 1000  # bins of a few hundred are merged whole


@pytest.mark.parametrize("mix", [packing.MIX, 100])
def test_pieces_clustered_by_length(spark, mix):
    """Files of long and of short documents only: a long and a short one fill a sequence."""
    sizes = [(i, 0, 0, 1100 if i < 1000 else 900, i) for i in range(2000)]
    pieces = spark.createDataFrame(sizes, "id long, piece int, start long, length long, crc long").repartitionByRange(2, "id")
    rows = packing.pack(pieces, capacity=2048, mix=mix).collect()
    assert sorted(r["id"] for r in rows) == list(range(2000))
    assert checked(rows, 2048) <= (1000 if mix == packing.MIX else 1080)


def test_pack_nothing(spark):
    pieces = spark.createDataFrame([], "id long, piece int, start long, length long, crc long")
    assert packing.pack(pieces, 10).collect() == []


def test_best_fit_takes_the_tightest_bin():
    bins, places, fills = packing.best_fit(np.array([6, 5, 4, 4, 1]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and places.tolist() == [0, 0, 6, 5, 9] and fills.tolist() == [10, 10]
