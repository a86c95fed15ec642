"""Bucketed tables, the log of seen records, versions and scratch tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import bucketed, versions
from shelfmark.operators.bucketed import BucketedTable, SeenLog, bucket_of
from shelfmark.operators.tables import upsert_overwrite
from shelfmark.operators.workspace import Scratch, shared_dir, written
from shelfmark.sources import adapters as ad
from shelfmark.streaming import imports
from shelfmark.streaming.imports import current_records, fold_staged, stage_stream
from tests.test_sources import book, write

ROW = "k long, v string"


def newest(stored, incoming):
    """Incoming values replace stored ones."""
    old = stored.join(incoming.select("k"), "k", "left_anti")
    return old.unionByName(incoming.groupBy("k").agg(F.max("v").alias("v")))


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def table_of(spark, folder, buckets=8):
    return BucketedTable(spark, f"{folder}/t", "k", buckets)


def contents(table, version=None):
    rows = table.rows(version)
    return {} if rows is None else {r["k"]: r["v"] for r in rows.collect()}


def test_upserts_by_definition(spark, folder):
    pick = random.Random(1)
    table, want = table_of(spark, folder), {}
    assert table.rows() is None and table.version() == 0
    for n in range(4):
        rows = [(pick.randrange(60), f"{n}-{i}") for i in range(25)]
        table.upsert(spark.createDataFrame(rows, ROW), newest)
        for k in {k for k, _ in rows}:
            want[k] = max(v for x, v in rows if x == k)
        assert contents(table) == want
    assert table.version() == 4 and len(contents(table, version=1)) <= 25
    assert table.upsert(spark.createDataFrame([], ROW), newest) == 4
    table.upsert(spark.createDataFrame([(None, "no key"), (None, "key")], ROW), lambda old, new: new.limit(1))
    assert None in contents(table)


def test_only_touched_buckets_are_written(spark, folder):
    table = table_of(spark, folder)
    table.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v")), newest)
    before, folders = files(folder), table.folders()
    own = {r["k"]: r["b"] for r in spark.range(200).select(F.col("id").alias("k"), bucket_of("id", 8).alias("b")).collect()}
    keys = [k for k in own if own[k] in (2, 5)][:6]
    table.upsert(spark.createDataFrame([(k, "b") for k in keys], ROW), newest)
    after = table.folders()
    assert {b for b in after if after[b] != folders[b]} == {own[k] for k in keys}
    assert before.items() <= files(folder).items()  # no file of the first version changed or went
    assert contents(table) == {k: "b" if k in keys else "a" for k in own}
    assert contents(table, version=1) == dict.fromkeys(own, "a")
    rows = table.rows(buckets={2})
    assert {own[r["k"]] for r in rows.collect()} == {2} and len(rows.inputFiles()) < len(table.rows().inputFiles())


def test_a_failed_upsert_changes_nothing(spark, folder, monkeypatch):
    table = table_of(spark, folder)
    table.upsert(spark.createDataFrame([(k, "a") for k in range(50)], ROW), newest)

    def breaks(*_):
        raise RuntimeError("before the commit")

    with monkeypatch.context() as m:
        m.setattr(bucketed, "commit", breaks)
        with pytest.raises(RuntimeError):
            table.upsert(spark.createDataFrame([(k, "lost") for k in range(20)], ROW), newest)
    assert table.version() == 1 and contents(table) == dict.fromkeys(range(50), "a")
    table.upsert(spark.createDataFrame([(1, "b")], ROW), newest)
    assert contents(table)[1] == "b" and "lost" not in contents(table).values()
    # what the failed attempt left lay in the folder of the same version and is gone
    used = {os.path.join(folder, "t", f) for f in table.folders().values()} | {os.path.join(folder, "t", f) for f in table.folders(1).values()}
    assert {os.path.dirname(f) for f in files(f"{folder}/t/data")} == used


def test_overwrite_in_buckets(spark, folder):
    """J2 through the same table: one row replaces the stored one but for the columns that stay."""
    schema = "md5 string, title string, edition string, quality_score int, created_at int"
    table = BucketedTable(spark, f"{folder}/t", buckets=4)
    for rows in ([("a", "old", "first", 5, 1), ("b", "x", None, 1, 1)], [("a", "new", None, 3, 2)]):
        table.upsert(spark.createDataFrame(rows, schema), lambda old, new: upsert_overwrite(old, new, keep_when_null=("edition",)))
    assert sorted(map(tuple, table.rows().select(*[c.split()[0] for c in schema.split(", ")]).collect())) == [
        ("a", "new", "first", 5, 1), ("b", "x", None, 1, 1),
    ]


def pairs(spark, numbers):
    return spark.createDataFrame([(f"k{n}", f"a{n}") for n in numbers], "md5 string, aacid string")


def test_seen_log(spark, folder):
    log = SeenLog(spark, f"{folder}/seen", buckets=4)
    assert log.hit(pairs(spark, [1])) == [] and log.unseen(pairs(spark, [1])).count() == 1
    log.append(pairs(spark, range(300)))
    log.append(pairs(spark, range(300, 320)))
    before = files(folder)
    log.append(pairs(spark, [900, 900]))
    log.append(pairs(spark, []))
    assert before.items() <= files(folder).items()  # appended only
    assert log.pairs().count() == 321
    asked = spark.createDataFrame([("k5", "a5"), ("k5", "other"), ("k310", "a310"), ("k999", "a999"), ("k5", None), (None, None)], "md5 string, aacid string")
    left = {tuple(r) for r in log.unseen(asked).collect()}
    assert left == {("k5", "other"), ("k999", "a999"), ("k5", None), (None, None)}


def test_a_replay_reads_only_deltas_that_its_filters_hit(spark, folder):
    log = SeenLog(spark, f"{folder}/seen", buckets=2)
    for n in range(4):
        log.append(pairs(spark, range(1000 * n, 1000 * n + 400)))
    every = {f for n in range(4) for f in log.hit(pairs(spark, range(1000 * n, 1000 * n + 400)))}
    assert len(every) == 8
    assert {f.split("/")[1] for f in log.hit(pairs(spark, range(1000, 1400)))} >= {"version=2"}
    assert len(log.hit(pairs(spark, [2005]))) <= 2  # its own delta, and seldom another
    strange = pairs(spark, range(50_000, 50_300))
    assert log.unseen(strange).count() == 300
    few = [f for n in range(40) for f in log.hit(pairs(spark, [70_000 + n]))]
    assert len(few) <= 20  # of 160 filters asked for what they do not hold


def test_compaction_of_the_log(spark, folder):
    """One delta for each bucket that had several, the same pairs, and files of others as they were."""
    log = SeenLog(spark, f"{folder}/seen", buckets=4)
    assert log.compact() == 0
    log.append(pairs(spark, range(200)))
    assert log.compact() == 1  # nothing to join
    alone = next(n for n in range(1000, 2000) if bucket_number(spark, n) == 3)
    log.append(pairs(spark, [*range(150), alone]).filter(bucket_of("md5", 4).isin(1, 3)))
    assert log.compact(most=2) == 2
    before, held = files(f"{folder}/seen/deltas"), [e["folder"] for e in bucketed.manifest(spark, log.base)]
    assert len(held) == 6
    assert log.compact() == 3
    after = [e["folder"] for e in bucketed.manifest(spark, log.base)]
    assert sorted(f.split("/")[1] for f in after) == ["version=1"] * 2 + ["version=3"] * 2 and len(set(after)) == 4
    assert before.items() <= files(f"{folder}/seen/deltas").items()
    assert sorted(map(tuple, log.pairs().collect())) == sorted((f"k{n}", f"a{n}") for n in [*range(200), alone])
    assert log.unseen(pairs(spark, [5, 150, alone, 500])).count() == 1


def bucket_number(spark, n):
    return pairs(spark, [n]).select(bucket_of("md5", 4).alias("b")).first()["b"]


def test_expiry_of_versions(spark, folder):
    table, log = table_of(spark, folder), SeenLog(spark, f"{folder}/seen", buckets=2)
    assert table.expire() == []
    table.upsert(spark.createDataFrame([(k, "a") for k in range(100)], ROW), newest)
    for n in range(3):
        table.upsert(spark.createDataFrame([(n, f"b{n}")], ROW), newest)
        log.append(pairs(spark, range(10 * n, 10 * n + 10)))
    want, older = contents(table), contents(table, version=3)
    with pytest.raises(ValueError):
        table.expire(keep=0)
    gone = table.expire(keep=2)
    assert gone and contents(table) == want and contents(table, version=3) == older and table.version() == 4
    assert {r["version"] for r in versions.manifests(spark, table.base).collect()} == {3, 4}
    used = {f"{table.base}/{f}" for v in (3, 4) for f in table.folders(v).values()}
    assert {os.path.dirname(f) for f in files(f"{table.base}/data")} == used
    assert table.expire(keep=2) == []
    table.upsert(spark.createDataFrame([(7, "c")], ROW), newest)  # numbers go on
    assert table.version() == 5 and contents(table) == want | {7: "c"}
    log.compact()
    assert {f.split("/")[0] for f in log.expire()} == {"deltas", "filters"}
    assert {d for f in files(log.base) for d in f.split("/") if d.startswith("version=")} == {"version=4"}
    assert log.pairs().count() == 30 and log.unseen(pairs(spark, [3, 29, 30])).count() == 1


def test_a_bucket_is_written_by_several_tasks(spark, folder):
    rows = spark.range(4000).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.enabled": "false"}
    before = {c: spark.conf.get(c) for c in settings}
    try:
        for c, v in settings.items():
            spark.conf.set(c, v)
        table = table_of(spark, folder, buckets=2)
        table.upsert(rows, newest)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    written_ = [f.split("/")[-2] for f in files(f"{folder}/t/data")]
    assert min(written_.count(f"bucket={b}") for b in (0, 1)) > 4 and contents(table) == dict.fromkeys(range(4000), "a")


def staged_dump(spark, folder, base):
    for i in range(3):
        write(f"{folder}/in", f"{i}.txt", [book(n, publisher=f"p{i}") for n in range(10 * i, 10 * i + 15)])
    return lambda **settings: stage_stream(spark, f"{folder}/in", ad.ZLIB3, base, 1, max_files=1, **settings).awaitTermination()


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_stop_between_batches_and_failure_in_a_fold(spark, folder, monkeypatch):
    """Both end in the records of an undisturbed run, and in no files besides."""
    stage = staged_dump(spark, folder, f"{folder}/whole")
    stage()
    want = rows_of(fold_staged(spark, f"{folder}/whole", 1))

    base, stage_one, calls = f"{folder}/stopped", imports._stage, []
    stage = staged_dump(spark, folder, base)

    def stops(batch, batch_id, *rest):
        calls.append(batch_id)
        if len(calls) == 2:
            raise RuntimeError("stopped between batches")
        stage_one(batch, batch_id, *rest)

    with monkeypatch.context() as m:
        m.setattr(imports, "_stage", stops)
        with pytest.raises(Exception, match="stopped between batches"):
            stage()
    assert len(calls) == 2
    stage()
    assert rows_of(imports.staged(spark, base, 1)) != []

    def breaks(self, rows):
        raise RuntimeError("after the records, before the log")

    with monkeypatch.context() as m:
        m.setattr(SeenLog, "append", breaks)
        with pytest.raises(RuntimeError):
            fold_staged(spark, base, 1)
    assert rows_of(fold_staged(spark, base, 1)) == want

    def fails(*_, **__):
        raise RuntimeError("within the merge")

    version = imports.record_table(spark, base).version()
    write(f"{folder}/in", "9.txt", [book(99)])
    stage()
    with monkeypatch.context() as m:
        m.setattr(imports, "upsert_merge", fails)
        with pytest.raises(RuntimeError):
            fold_staged(spark, base, 1)
    assert rows_of(current_records(spark, base)) == want and imports.record_table(spark, base).version() == version
    assert len(rows_of(fold_staged(spark, base, 1))) == len(want) + 1
    data = f"{base}/records/data"
    used = {f"{base}/records/{f}" for v in range(1, imports.record_table(spark, base).version() + 1) for f in imports.record_table(spark, base).folders(v).values()}
    assert {os.path.dirname(f) for f in files(data)} <= used


def test_scratch_leaves_only_the_result(spark):
    def there():
        root = shared_dir(spark)
        return {n for n in os.listdir(root) if n.startswith(("scratch_", "result"))}

    before = there()
    with Scratch(spark) as tmp:
        a = tmp.written(spark.range(10), "some-rows")
        b = tmp.written(a.selectExpr("id * 2 as id"), "some-rows")
        inside = there() - before
        assert len(inside) == 1 and b.count() == 10
        tmp.drop(a)
        name = os.path.join(shared_dir(spark), inside.pop())
        assert len(os.listdir(name)) == 1
        result = written(b.filter("id > 4"), "result")
    assert result.count() == 7
    assert all(n.startswith("result") for n in there() - before)
    with pytest.raises(ZeroDivisionError), Scratch(spark) as tmp:
        tmp.written(spark.range(3), "x")
        raise ZeroDivisionError
    assert all(n.startswith("result") for n in there() - before)


def test_upkeep_between_imports(spark, folder):
    base = f"{folder}/base"
    stage = staged_dump(spark, folder, base)
    stage()
    fold_staged(spark, base, 1)
    write(f"{folder}/in", "3.txt", [book(n, publisher="late") for n in range(40, 45)])
    stage()
    want = rows_of(fold_staged(spark, base, 1))
    before = files(base)
    imports.tidy(spark, base, keep=1, most=1)
    left = files(base)
    assert len([f for f in left if "/records/data/" in f or "/seen/deltas/" in f]) < len([f for f in before if "/records/data/" in f or "/seen/deltas/" in f])
    assert not any("/manifests/version=1" in f for f in left)
    assert rows_of(current_records(spark, base)) == want
    log = imports.seen_log(spark, base)
    assert log.compact() == versions.latest_version(spark, log.base)  # nothing left to join
    assert rows_of(fold_staged(spark, base, 1)) == want  # a replay still finds all it has merged
