"""Damaged payloads, the error gate and streams that forget."""

import bz2
import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.gate import ErrorGate, gate_outcomes
from shelfmark.plans.imports import import_release
from shelfmark.sources import adapters as ad
from shelfmark.sources.salvage import breaks, payloads, read_frames, salvaged
from shelfmark.streaming.buckets import first_of_bursts, performance_buckets
from tests.test_sources import book, write


def lines(name, n):
    return [f"{name} line {i} " + str(random.Random(f"{name}{i}").random()) for i in range(n)]


def packed(*groups):
    return [gzip.compress("\n".join([*g, ""]).encode()) for g in groups]


def frames_of(spark, contents, **settings):
    df = spark.createDataFrame([(n, bytearray(c) if c is not None else None) for n, c in contents.items()], "file string, content binary")
    return read_frames(df, **settings).cache()


def told(frames):
    found = {}
    for r in salvaged(frames).orderBy("seq").collect():
        found.setdefault(r["file"], []).append(r["line"])
    return found, {(r["file"], r["frame"], r["start"], r["lines"]) for r in breaks(frames).collect()}


@pytest.mark.parametrize("partial", [True, False])
def test_whole_frames(spark, partial):
    a, b = lines("a", 400), lines("b", 3)
    one, two = packed(a, b)
    contents = {
        "whole": one + two, "zeroed": one + two[:20] + bytes(15) + two[35:] + one, "junk between": b"junk" + two + b"\x1f\x8b junk" + one,
        "no end of line": gzip.compress(b"x\n\n  y  "), "empty": b"", "null": None, "no frame": b"plain text", "other": bz2.compress(b"x\n"),
    }
    found, broken = told(frames_of(spark, contents, partial=partial))
    assert found["whole"] == a + b and found["junk between"] == b + a and found["no end of line"] == ["x", "y"]
    assert found["zeroed"][:400] == a and found["zeroed"][-400:] == a
    assert {(f, n, s) for f, n, s, _ in broken} == {("zeroed", 1, len(one))}
    assert set(found) == {"whole", "zeroed", "junk between", "no end of line"}


def test_truncated_payload(spark):
    """Of the last frame the whole lines before the break count, or none; the break is the byte at which the frame starts."""
    a, b = lines("a", 300), lines("b", 3000)
    one, two = packed(a, b)
    cut = (one + two)[: len(one) + len(two) // 2]
    found, broken = told(frames_of(spark, {"f": cut}))
    assert found["f"][:300] == a and a + b[: len(found["f"]) - 300] == found["f"]
    assert 300 < len(found["f"]) < 3300 and broken == {("f", 1, len(one), len(found["f"]) - 300)}
    found, broken = told(frames_of(spark, {"f": cut}, partial=False))
    assert found["f"] == a and broken == {("f", 1, len(one), 0)}


def test_zstd_frames(spark):
    zstandard = pytest.importorskip("zstandard")
    a, b, c = lines("a", 50), lines("b", 50), lines("c", 50)
    frames = [zstandard.ZstdCompressor(write_checksum=True).compress("\n".join(g).encode()) for g in (a, b, c)]
    middle = bytes(len(frames[1]))
    found, broken = told(frames_of(spark, {"whole": b"".join(frames), "lost": frames[0] + middle + frames[2], "cut": frames[0] + frames[1][:-30]}))
    assert found["whole"] == a + b + c and found["lost"] == a + c and found["cut"][:50] == a
    assert {(f, n, s) for f, n, s, _ in broken} == {("cut", 1, len(frames[0]))}


def test_damaged_files_on_disk(spark, folder):
    os.makedirs(f"{folder}/in")
    one, two = packed([book(n) for n in range(20)], [book(n) for n in range(20, 40)])
    with open(f"{folder}/in/a.gz", "wb") as f:
        f.write(one + two[:-20])
    frames = read_frames(payloads(spark, f"{folder}/in"), partial=False)
    rows = ad.adapt(salvaged(frames), ad.ZLIB3)
    assert rows.filter("outcome = 'kept'").count() == 20
    assert [r["start"] for r in breaks(frames).collect()] == [len(one)]


def test_gate_ends_the_scan(spark, folder):
    """Too many failures cancel the job: later files are not read. A good payload goes through, counted once."""
    for i in range(160):
        write(f"{folder}/bad", f"{i:03}.txt", ["{"] * 300 if i < 120 else [book(i)] * 300)
    keys = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "2k"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        gate = ErrorGate(spark, check_after=1000, every=0.02)
        slow = F.expr("java_method('java.lang.Thread', 'sleep', 1L)")
        rows = ad.adapt(spark.read.text(f"{folder}/bad").select(F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line")), ad.ZLIB3)
        with pytest.raises(RuntimeError, match="was not read"):
            gate.write(gate.watched(rows.withColumn("_slow", slow)), f"{folder}/out")
        assert gate.tripped and 1000 <= gate.seen.value < 160 * 300 * 0.8
        assert not spark.sparkContext.statusTracker().getActiveStageIds()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    write(f"{folder}/good", "a.txt", [book(n) for n in range(100)] + ["{"])
    good = ErrorGate(spark)
    good.write(good.watched(ad.adapt(spark.read.text(f"{folder}/good").select(F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line")), ad.ZLIB3)), f"{folder}/out2")
    assert (good.seen.value, good.failed.value, good.tripped) == (101, 1, False)
    assert spark.read.parquet(f"{folder}/out2").filter("outcome = 'failed'").count() == 1
    result = import_release(spark, f"{folder}/good", ad.ZLIB3)
    assert result.seen.count() == 100


def test_gate_outcomes_by_definition(spark):
    pick = random.Random(4)
    rows = []
    for payload in range(30):
        rate = pick.choice([0, 0.05, 0.3, 0.9])
        rows += [(payload, piece, pick.choice([0, 0, 1]), "failed" if pick.random() < rate else "kept") for piece in range(5) for _ in range(pick.randrange(8))]
    df = spark.createDataFrame(rows, "payload int, piece int, part int, outcome string")
    want = {}
    for payload in {r[0] for r in rows}:
        seen = failed = 0
        stop = None
        for piece in sorted({r[1] for r in rows if r[0] == payload}):
            own = [r for r in rows if r[:2] == (payload, piece)]
            seen, failed = seen + sum(r[2] == 0 for r in own), failed + sum(r[3] == "failed" for r in own)
            if seen >= 6 and failed > 0.2 * seen:
                stop = piece
                break
        outcome = "empty" if seen == 0 else "aborted" if stop is not None or failed > 0.2 * seen else "kept"
        want[payload] = (seen, failed, stop, outcome)
    got = {r["payload"]: tuple(r)[1:] for r in gate_outcomes(df, "payload", "piece", 0.2, 6).collect()}
    assert got == want and len({w[3] for w in want.values()}) >= 2


def streamed(spark, folder, batches, make, mode):
    """Batches of rows as files, one to a micro-batch: what came out by batch, and the rows of state after each."""
    schema, path, out = "key string, ts timestamp, n long", f"{folder}/in", []
    for rows in batches:
        df = spark.createDataFrame(rows, "key string, at string, n long").selectExpr("key", "cast(at as timestamp) as ts", "n")
        df.coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = make(source).writeStream.outputMode(mode).foreachBatch(lambda df, _: out.append([tuple(r) for r in df.collect()]))
    query = query.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return out, state


def test_a_repeat_after_the_watermark_is_let_through(spark, folder):
    day = "2024-05-01"
    batches = [
        [("a", f"{day} 10:00:00", 1), ("a", f"{day} 10:03:00", 2), ("b", f"{day} 10:04:00", 3)],
        [("a", f"{day} 10:09:00", 4), *((f"x{i}", f"{day} 11:00:00", i) for i in range(20))],
        [("a", f"{day} 12:00:00", 5), ("b", f"{day} 12:01:00", 6)],
        [("end", f"{day} 15:00:00", 0)],
        [("end", f"{day} 18:00:00", 0)],
    ]
    out, state = streamed(spark, folder, batches, lambda s: first_of_bursts(s, ["key"]).select("key", F.date_format("first_at", "HH:mm"), "n"), "append")
    rows = [r for b in out for r in b if r[0] in "ab"]
    assert sorted(rows) == [("a", "10:00", 3), ("a", "12:00", 1), ("b", "10:04", 1), ("b", "12:01", 1)]
    assert max(state) <= 24 and state[-1] <= 2  # open bursts only, not all keys ever seen
    batch = spark.createDataFrame([r for b in batches for r in b], "key string, at string, n long").selectExpr("key", "cast(at as timestamp) as ts")
    again = first_of_bursts(batch, ["key"]).filter("key in ('a', 'b')").select("key", F.date_format("first_at", "HH:mm"), "n")
    assert sorted(map(tuple, again.collect())) == sorted(rows)


def test_a_bucket_is_updated_over_batches(spark, folder):
    day = "2024-05-01"
    batches = [[("r", f"{day} 10:01:00", 1)], [("r", f"{day} 10:02:00", 5), ("r", f"{day} 10:06:00", 6)], [("r", f"{day} 10:04:00", 7)], [("r", f"{day} 10:40:00", 9)]]

    def make(stream):
        named = stream.select(F.col("key").alias("release_id"), "ts", F.col("n").alias("records_seen"), (F.col("n") * 10).alias("bytes"))
        return performance_buckets(named).select(F.date_format("bucket_start", "HH:mm"), "first_records", "last_records", "last_bytes")

    out, state = streamed(spark, folder, batches, make, "update")
    updates = [sorted(b) for b in out if b]
    assert updates == [[("10:00", 1, 1, 10)], [("10:00", 1, 5, 50), ("10:05", 6, 6, 60)], [("10:00", 1, 7, 70)], [("10:40", 9, 9, 90)]]
    assert state[-1] <= 2


def test_chance_bytes_are_no_frame(spark):
    """after a break only a valid header begins a frame, and a broken one counts once."""
    import gzip

    whole = gzip.compress(b"one\ntwo\n", mtime=0)
    chance = b"\x1f\x8b\x08\xff\x11\x22\x33\x44\x77\x99"
    stray = b"\x28\xb5\x2f\xfd\x08"  # the reserved bit is set
    broken = whole[:12] + chance + b"rest" + stray + b"rest"
    files = spark.createDataFrame([("a", whole + broken + whole), ("b", whole + broken + broken + whole), ("c", chance + whole)], "file string, content binary")
    frames = read_frames(files, partial=False).collect()
    at = lambda f: sorted((r["frame"], r["start"]) for r in frames if r["file"] == f and r["broken"])
    n, m = len(whole), len(broken)
    assert at("a") == [(1, n)] and at("b") == [(1, n), (2, n + m)] and at("c") == [(0, 0)]
    assert [sum(r["line"] is not None for r in frames if r["file"] == f) for f in "abc"] == [4, 4, 2]
