"""Reports against their definitions on random ledgers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import discards
from shelfmark.plans import reports
from shelfmark.streaming.buckets import performance_buckets

START = dt.datetime(2031, 5, 6, 7, 0)


def names(spark, *values, column="subcollection"):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


@pytest.mark.parametrize("seed", range(3))
def test_rates_by_definition(spark, seed):
    """Samples of cumulative counters: per release and five minutes the difference over the time between them."""
    rng = random.Random(seed)
    samples = []
    for release in range(1, 5):
        at, seen, size = START + dt.timedelta(seconds=rng.randrange(900)), 0, 0
        for _ in range(rng.randrange(1, 12)):
            samples.append((release, at, seen, size))
            at += dt.timedelta(seconds=rng.randrange(1, 400))
            seen += rng.randrange(-3, 700)  # a restarted counter may fall
            size += rng.randrange(5000)
    df = spark.createDataFrame(samples, "release_id int, ts timestamp, records_seen long, bytes long")
    releases = spark.createDataFrame([(n, f"set{n % 2}") for n in range(1, 5)], "release_id int, collection string")
    want = []
    spans = {}
    for release, at, seen, size in samples:
        spans.setdefault((release, int((at - START).total_seconds()) // 300), []).append((at, seen, size))
    for (release, _), rows in spans.items():
        (a, seen_a, size_a), (b, seen_b, size_b) = min(rows), max(rows)
        if seconds := (b - a).total_seconds():
            want.append((f"set{release % 2}", max(0.0, (seen_b - seen_a) / seconds), max(0.0, (size_b - size_a) / seconds)))
    as_of = F.lit(str(START + dt.timedelta(hours=3))).cast("timestamp")
    rows = reports.bucket_rates(performance_buckets(df), releases, as_of).collect()
    got = [(r["collection"], r["records_per_second"], r["bytes_per_second"]) for r in rows]
    assert sorted(got) == pytest.approx(sorted(want)) if not want else all(
        g[0] == w[0] and g[1:] == pytest.approx(w[1:]) for g, w in zip(sorted(got), sorted(want), strict=True)
    )
    old = F.lit(str(START + dt.timedelta(days=2))).cast("timestamp")
    assert reports.bucket_rates(performance_buckets(df), releases, old).isEmpty()


def test_shares_of_a_random_split(spark):
    rng = random.Random(8)
    picked = [rng.choice(["maps", "scores", "letters"]) for _ in range(97)]
    rows = names(spark, *picked, column="kind")
    active = names(spark, "maps", "posters", column="kind")
    got = {r["kind"]: (r["n"], r["share"], r["bytes"]) for r in reports.shares(rows, active, "kind", 7_777).collect()}
    assert set(got) == {*picked, "posters"}
    for kind, (n, part, size) in got.items():
        assert n == picked.count(kind) and part == pytest.approx(n / 97) and size == round(7_777 * n / 97)
    nothing = reports.shares(rows.limit(0), active, "kind", 7_777).collect()
    assert {r["kind"]: r["n"] + r["share"] + r["bytes"] for r in nothing} == {"maps": 0, "posters": 0}


def test_names_of_a_fixed_set(spark):
    values = ["x"] * 5 + ["y"] * 3 + [None] * 2 + ["w"]
    got = reports.fixed_name_counts(names(spark, *values, column="k"), names(spark, "y", "v", "y", column="k"), "k").collect()
    assert {(r["k"], r["n"], r["scanned"]) for r in got} == {("y", 3, 11), ("v", 0, 11)}


def test_an_override_decides_over_the_default(spark):
    overrides = spark.createDataFrame([("p", True), ("r", False), ("s", True)], "subcollection string, blocked boolean")
    got = {r["subcollection"]: r["blocked"] for r in discards.effective_filters(names(spark, "p", "q", "r"), overrides).collect()}
    assert got == {"p": True, "q": True, "r": False, "s": True}


def test_impact_of_filters_by_definition(spark):
    """A recount of a group in a release replaces what its import counted; the latest release and the sum count."""
    rng = random.Random(11)
    groups, releases = ["g1", "g2", "g3", "g4"], [(n, f"id{n}", START + dt.timedelta(days=n)) for n in range(1, 6)]
    imported = [(*r, f"blocked_subcollection:{g}", rng.randrange(1, 50)) for r in releases for g in groups if rng.random() < 0.7]
    imported += [(*r, "too_short", rng.randrange(1, 50)) for r in releases]
    recounted = [(*r, g, rng.randrange(1, 50)) for r in releases[2:4] for g in groups[:3]]
    filtered = reports.recomputed_replaces(
        reports.counted_filters(
            spark.createDataFrame(imported, "release_id int, release_identifier string, discovered_at timestamp, reason string, n long")
        ),
        spark.createDataFrame(recounted, "release_id int, release_identifier string, discovered_at timestamp, subcollection string, n long"),
    )
    again = {(r[0], r[3]) for r in recounted}
    kept = [(t, i, g, n) for i, _, t, g, n in recounted]
    kept += [(t, i, r.split(":")[1], n) for i, _, t, r, n in imported if ":" in r and (i, r.split(":")[1]) not in again]
    got = reports.filter_impact(names(spark, *groups, "none"), spark.createDataFrame([("g2", False)], "subcollection string, blocked boolean"), filtered, 3.0)
    rows = {r["subcollection"]: r for r in got.collect()}
    assert set(rows) == {*groups, "none"}
    for g in groups:
        own = sorted(x for x in kept if x[2] == g)
        assert rows[g]["total"] == sum(x[3] for x in own)
        assert rows[g]["latest"] == own[-1][3]
        assert rows[g]["blocked"] == (g != "g2")
    assert rows["none"]["total"] == 0 and rows["none"]["latest"] is None


def test_count_within_a_time(spark, folder):
    """Both ways: exact, and an estimate from some files after the count was cancelled; nothing runs on after the answer."""
    assert reports.counted_within(spark.range(1234), 60) == (1234, 1234, 1234, True)
    spark.range(0, 60_000, 1, 60).write.parquet(f"{folder}/even")
    spark.range(20_000).selectExpr("id", "if(id < 15000, 0, id % 40) as f").repartition(40, "f").write.parquet(f"{folder}/uneven")
    with pytest.raises(TimeoutError):
        reports.counted_within(spark.range(10**13).filter("id % 7 = 3"), 0.5)
    assert not spark.sparkContext.statusTracker().getActiveStageIds()
    slow = F.expr("java_method('java.lang.Thread', 'sleep', 20L) is null or id >= 0")
    even = spark.read.parquet(f"{folder}/even")
    got = reports.counted_within(even.filter(slow), 0.5, files=10)
    assert not got.exact and got.low <= 60_000 <= got.high and abs(got.rows - 60_000) < 100
    assert not spark.sparkContext.statusTracker().getActiveStageIds()
    uneven = spark.read.parquet(f"{folder}/uneven")
    got = reports.counted_within(uneven.filter(slow), 0.2, files=100)
    assert got.rows == 20_000 and got.exact  # all its files were drawn
