"""Repeated passages against a plain search of all windows."""

import random
import re

import pytest
import xxhash

from shelfmark.llm import fixed_blocks

SCHEMA = "doc_id long, text string, lot string, marks long, words int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, 1) for i, t in rows], SCHEMA)


def brute_force(rows, window):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, xxhash.xxh32_intdigest((r[1] or "").encode())))
    seen, out = set(), []
    for i, text in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for at in range(len(words) - window + 1):
            run = tuple(words[at : at + window])
            if run in seen:
                gone.update(range(at, at + window))
            seen.add(run)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        spans = [(k, next(e for e in range(k, len(words) + 1) if e not in gone)) for k in sorted(gone) if k - 1 not in gone]
        out.append((i, kept, len(words), len(gone), spans))
    return sorted(out, key=str)


def found(docs, **settings):
    rows = fixed_blocks.without_repeats(docs, **settings).collect()
    return sorted(((r["id"], r["text"], r["n_words"], r["n_removed"], [tuple(s) for s in r["removed"]]) for r in rows), key=str)


def passages(seed, docs, window):
    """Texts of own words and of passages about as long as a window, some cut, shifted, nested or changed."""
    pick = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["é", "日本", "a b"]
    stock = [[pick.choice(vocabulary) for _ in range(pick.randint(window - 2, 4 * window))] for _ in range(6)]
    rows = []
    for n in range(docs):
        words = []
        for _ in range(pick.randint(0, 5)):
            words += [pick.choice(vocabulary) for _ in range(pick.randint(0, 12))]
            if pick.random() < 0.7:
                part = pick.choice(stock)
                a = pick.randint(0, 3)
                part = part[a : len(part) - pick.randint(0, 3)]
                if part and pick.random() < 0.3:
                    part = [*part]
                    part[pick.randrange(len(part))] = "changed"
                words += part
        rows.append((pick.randint(0, 10 * docs), pick.choice([" ", "\n", " \t"]).join(words)))
    return rows


ROWS = [
    (1, None), (2, ""), (3, "  \n "), (4, "one two three"), (5, "a " * 300), (6, "a " * 19), (7, "a " * 20), (8, "A " * 20),
    (9, " ".join(map(str, range(50)))), (9, " ".join(map(str, range(50)))), (10, " ".join(map(str, range(5, 40)))),
    (11, "x " + " ".join(map(str, range(31, 51))) + " y"), (None, " ".join(map(str, range(50)))), (None, "own"),
    (12, " ".join(f"l{k}" for k in range(30000))), (13, " ".join(f"l{k}" for k in range(29000, 30000))),
    (9, "other " + " ".join(map(str, range(50)))),
]


@pytest.mark.parametrize("settings", [{}, {"lot_words": 1}, {"lot_words": 100, "bucket_entries": 50}])
def test_edge_cases(spark, settings):
    assert found(frame(spark, ROWS), **settings) == brute_force(ROWS, 20)


@pytest.mark.parametrize("seed,window", [(1, 20), (2, 20), (3, 7), (4, 2), (5, 1)])
def test_random_passages(spark, seed, window):
    rows = passages(seed, 60, window)
    assert found(frame(spark, rows).repartition(5), window=window, lot_words=300) == brute_force(rows, window)


def test_any_division_gives_the_same(spark):
    rows = passages(9, 80, 20)
    one = found(frame(spark, rows).coalesce(1))
    assert one == found(frame(spark, rows).repartition(7), lot_words=50) == brute_force(rows, 20)


def test_empty_table(spark):
    assert found(frame(spark, [])) == []


def test_common_passage_sends_one_entry_for_each_lot(spark):
    """A passage of a third of all documents does not make more messages than lots and buckets."""
    common = " ".join(f"c{k}" for k in range(40))
    rows = [(n, f"{common} own{n}" if n % 3 == 0 else f"only{n} text{n}") for n in range(900)]
    lot = fixed_blocks.Lot(fixed_blocks.lots(frame(spark, rows).select("doc_id", "text").toDF("id", "text").coalesce(1), 1 << 18).first()["body"])
    anchors = fixed_blocks.Anchors(lot, 10, 8)
    assert len(anchors.hashes) < 31 + 300 * 2
    assert found(frame(spark, rows)) == brute_force(rows, 20)
