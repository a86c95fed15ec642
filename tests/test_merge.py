"""A1/A3 against a plain Python fold on random histories, on both sides of the hot-key split."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.merge import MergeSpec, merge_versions, ordered_union, with_late
from shelfmark.operators.tables import once_per_record, unseen, upsert_counts, upsert_merge, upsert_overwrite

SPEC = MergeSpec(
    key="k", scalars=["title", "filesize"], arrays=["authors", "doi"],
    provenance=["source_collection"], last=["aacid"], first=["ipfs_cid"],
)
SCHEMA = (
    "k string, seq long, quality_score short, source_timestamp timestamp, title string, filesize long,"
    " authors array<string>, doi array<string>, source_collection string, aacid string,"
    " ipfs_cid string, deleted boolean, removed_reason string"
)
DAY = [dt.datetime(2024, 1, d) for d in range(1, 7)]


def fold(versions):
    """The rule told one version at a time."""
    out = None
    best, newest = None, None
    for v in versions:
        score, ts = v["quality_score"], v["source_timestamp"]
        if out is None:
            out = dict(v)
            best, newest = score, ts
            continue
        is_newer = ts is not None and (newest is None or ts > newest)
        for f in ("title", "filesize"):
            if v[f] in (None, ""):
                continue
            if out[f] in (None, "") or score > best or (score == best and is_newer):
                out[f] = v[f]
        for f in ("authors", "doi"):
            out[f] = out[f] + [x for x in v[f] if x not in out[f]]
        if score >= best and v["source_collection"]:
            out["source_collection"] = v["source_collection"]
        out["aacid"] = v["aacid"] or out["aacid"]
        out["ipfs_cid"] = out["ipfs_cid"] or v["ipfs_cid"]
        if v["deleted"]:
            if not out["deleted"]:
                out["deleted"], out["removed_reason"] = True, v["removed_reason"]
        elif out["deleted"] and is_newer:
            out["deleted"], out["removed_reason"] = False, None
        best = max(best, score)
        newest = max([t for t in (newest, ts) if t is not None], default=None)
    out["quality_score"], out["source_timestamp"] = best, newest
    if out["deleted"] is False:
        out["removed_reason"] = None
    seen = []
    for f in ("authors", "doi"):
        seen = []
        for x in out[f]:
            if x not in seen:
                seen.append(x)
        out[f] = seen
    return out


def history(rng, key, n, start):
    rows = []
    for i in range(n):
        gone = rng.random() < 0.3
        rows.append(
            dict(
                k=key, seq=start + i, quality_score=rng.choice([5, 10, 10, 20]),
                source_timestamp=rng.choice([None, *DAY]),
                title=rng.choice([None, "", "a", "b", "c", "d"]),
                filesize=rng.choice([None, 0, 1, 2]),
                authors=rng.sample(["x", "y", "z"], rng.randrange(3)),
                doi=rng.sample(["1", "2", "3", "4"], rng.randrange(3)),
                source_collection=rng.choice(["", "s1", "s2"]),
                aacid=rng.choice([None, "r1", "r2"]), ipfs_cid=rng.choice([None, "c1", "c2"]),
                deleted=gone, removed_reason=rng.choice(["why", "because", None]) if gone else None,
            )
        )
    return rows


def histories(seed=7, keys=400, longest=9):
    rng = random.Random(seed)
    out, at = {}, 0
    for i in range(keys):
        n = rng.randrange(1, longest)
        out[f"k{i}"] = history(rng, f"k{i}", n, at)
        at += n
    return out


def frame(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def compare(got, expected):
    assert len(got) == len(expected)
    for row in got:
        r = row.asDict()
        want = expected[r["k"]]
        for f in r:
            assert (r[f] or None) == (want[f] or None) or (f == "filesize" and r[f] == want[f]), (
                r["k"], f, r[f], want[f],
            )


@pytest.mark.parametrize("hot_rows", [1_000_000, 3, 1])
def test_merge_equals_fold(spark, hot_rows):
    data = histories()
    rows = [r for h in data.values() for r in h]
    got = merge_versions(frame(spark, rows).repartition(5), SPEC, hot_rows).collect()
    compare(got, {k: fold(h) for k, h in data.items()})


def test_long_history_of_one_key(spark):
    rng = random.Random(3)
    rows = history(rng, "hot", 3000, 0) + history(rng, "cold", 5, 3000)
    got = merge_versions(frame(spark, rows).repartition(5), SPEC, 100).collect()
    compare(got, {"hot": fold(rows[:3000]), "cold": fold(rows[3000:])})


def test_best_score_is_not_the_score_of_the_value(spark):
    rows = history(random.Random(0), "k", 3, 0)
    for r, (s, t) in zip(rows, [(10, "x"), (20, None), (15, "z")], strict=True):
        r.update(quality_score=s, title=t, source_timestamp=None, deleted=False, removed_reason=None)
    assert merge_versions(frame(spark, rows), SPEC).first()["title"] == "x"


def test_batches_give_the_same_rows_as_one_merge(spark):
    data = histories(seed=11, keys=150)
    rows = [r for h in data.values() for r in h]
    rng = random.Random(5)
    cut = {r["seq"]: rng.random() < 0.5 for r in rows}
    for h in data.values():  # a prefix of each history is stored first
        n = rng.randrange(len(h) + 1)
        for i, r in enumerate(h):
            cut[r["seq"]] = i < n
    early = frame(spark, [r for r in rows if cut[r["seq"]]])
    late = frame(spark, [r for r in rows if not cut[r["seq"]]])
    stored = merge_versions(early, SPEC)
    compare(upsert_merge(stored, late, SPEC).collect(), {k: fold(h) for k, h in data.items()})


def test_replay_changes_nothing_with_seen_records(spark):
    data = histories(seed=23, keys=100)
    rows = []
    for h in data.values():
        for r in h:
            r["aacid"] = f"a{r['seq']}"
            rows.append(r)
    all_rows = frame(spark, rows)
    stored = merge_versions(all_rows, SPEC)
    fresh = unseen(all_rows, all_rows.select("k", "aacid"), key="k")
    assert fresh.count() == 0
    again = upsert_merge(stored, fresh, SPEC)
    compare(again.collect(), {k: fold(h) for k, h in data.items()})


def test_repeats_of_a_record_are_dropped_once(spark):
    rows = history(random.Random(1), "k", 4, 0)
    for r, a in zip(rows, ["a", "a", None, None], strict=True):
        r["aacid"] = a
    kept = once_per_record(frame(spark, rows), key="k").select("seq").collect()
    assert sorted(r["seq"] for r in kept) == [0, 2, 3]


def test_other_versions_under_one_reference_stay(spark):
    df = spark.createDataFrame(
        [("k", 1, "a", "x", None), ("k", 2, "a", None, "x"), ("k", 3, "a", "x", None), ("k", 4, None, "x", None), ("k", 5, None, "x", None)],
        "k string, seq long, aacid string, title string, publisher string",
    )
    kept = once_per_record(df, key="k", content=("title", "publisher")).select("seq").collect()
    assert sorted(r["seq"] for r in kept) == [1, 2, 4, 5]


def test_ordered_union_keeps_first_places(spark):
    df = spark.createDataFrame(
        [("k", 2, ["b", "a"], []), ("k", 1, ["c", "b"], ["z"]), ("j", 3, [], [])],
        "k string, seq long, x array<string>, y array<string>",
    )
    got = ordered_union(df, "k", "seq", ["x", "y"]).collect()
    assert [(r["k"], r["x"], r["y"]) for r in got] == [("k", ["c", "b", "a"], ["z"])]


def test_overwrite_mode_and_counts(spark):
    old = spark.createDataFrame(
        [("a", "t1", "s", 5, "c0", "u0"), ("b", "t2", None, 9, "c0", "u0")],
        "md5 string, title string, series_name string, quality_score int, created_at string, updated_at string",
    )
    new = spark.createDataFrame(
        [("a", None, None, 3, "c1", "u1"), ("d", "t4", "q", 1, "c1", "u1")], old.schema
    )
    got = {r["md5"]: tuple(r)[1:] for r in upsert_overwrite(old, new).collect()}
    assert got == {
        "a": (None, "s", 5, "c0", "u1"), "b": ("t2", None, 9, "c0", "u0"), "d": ("t4", "q", 1, "c1", "u1"),
    }
    assert upsert_counts(old, new).first().asDict() == {"inserted": 1, "updated": 1}


def test_plan_without_hot_keys_has_one_sort_path(spark):
    df = spark.range(1000).select(
        F.col("id").cast("string").alias("k"), F.col("id").alias("seq"),
        F.lit(1).cast("short").alias("quality_score"), F.lit(None).cast("timestamp").alias("source_timestamp"),
        F.lit("t").alias("title"), F.lit(1).cast("long").alias("filesize"),
        F.array(F.lit("a")).alias("authors"), F.array(F.lit("d")).alias("doi"),
        F.lit("s").alias("source_collection"), F.lit("r").alias("aacid"), F.lit("c").alias("ipfs_cid"),
        F.lit(False).alias("deleted"), F.lit(None).cast("string").alias("removed_reason"),
    )
    merged = merge_versions(df, SPEC)
    assert merged.count() == 1000


@pytest.mark.parametrize("hot_rows", [10_000, 3])
def test_a_late_scalar_is_the_merged_one(spark, hot_rows):
    """a long value fetched after the merge is the one the fold keeps, and the merge itself never sees it."""
    import dataclasses

    rows = frame(spark, [v for h in histories(keys=60).values() for v in h])
    spec = dataclasses.replace(SPEC, scalars=["filesize"], late=["title"])
    merged = merge_versions(rows, spec, hot_rows)
    assert "title" not in merged.columns and "title" not in spec.columns()
    named = with_late(merged, rows, spec).drop("title_at")
    plain = merge_versions(rows, SPEC, hot_rows).select(*named.columns)
    text = lambda df: sorted(str(r.asDict() | {"title": r["title"] or None}) for r in df.collect())
    assert text(named) == text(plain)
