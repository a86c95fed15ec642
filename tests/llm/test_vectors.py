"""Codes and clusters of vectors by the plain definitions, in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from shelfmark.llm import bit_planes, equal_average, queries

SCHEMA = "vec_id long, embedding array<double>, label int, id string, code int, cluster int, distance string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2, "y") for i, v, label in rows], SCHEMA)


def vectors(seed, n, dims=64, spread=0.3):
    pick = random.Random(seed)
    own = [[pick.gauss(0, spread) for _ in range(dims)] for _ in range(n)]
    return [(k * 3, v, pick.choice([0, 1, None])) for k, v in enumerate(own)]


ODD = [
    (-5, None, 1), (-4, [], 1), (-3, [0.1] * 63, 1), (-2, [0.1] * 63 + [None], 1), (-1, [0.1] * 63 + [math.nan], 2),
    (-6, [0.1] * 63 + [math.inf], 2), (-7, [1e300] * 64, 2),
]


def whole(v, scale, dims=64, limit=1 << 26):
    if v is None or len(v) != dims or any(x is None or not math.isfinite(x) for x in v):
        return None
    out = [math.floor(scale * x) for x in v]
    return None if max(map(abs, out)) > limit else out


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def best(part, entries):
    return min((square(part, e), k) for k, e in enumerate(entries))


def plain_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [(i, label, w) for i, v, label in rows if (w := whole(v, scale)) is not None]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))
    width = 64 // parts
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for _, _, w in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(best(c[p], books[p])[1], []).append(c[p])
            for k, m in members.items():
                books[p][k] = [sum(x) // len(m) for x in zip(*m)]
    out, by_label = [], {}
    for (i, label, _), c in zip(kept, cut):
        found = [best(c[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        by_label[label] = by_label.get(label, 0) + out[-1][3]
    listed = ",".join(str(x) for book in books for e in book for x in e)
    return sorted([(i, c, e, by_label[label]) for i, label, c, e in out], key=str), listed


def codes_of(docs, **settings):
    rows, books = equal_average.compressed(docs, settings=equal_average.Settings(**settings))
    got = sorted(((r["id"], r["code"].hex(), r["error"], r["label_error"]) for r in rows.collect()), key=str)
    return got, equal_average.joined(books)


@pytest.mark.parametrize("seed,n,parts", [(1, 300, 16), (2, 40, 16), (3, 90, 8), (4, 1, 16), (5, 70, 4)])
def test_codes(spark, seed, n, parts):
    rows = vectors(seed, n) + ODD
    assert codes_of(frame(spark, rows).repartition(4), parts=parts) == plain_codes(rows, parts)


def test_codes_of_ties_repeats_and_null_ids(spark):
    pick = random.Random(8)
    few = [[pick.choice([0.0, 1 / 256, 2 / 256]) for _ in range(64)] for _ in range(20)]
    rows = [(pick.choice([1, 2, 3, 70, None]), pick.choice(few), pick.choice([4, None])) for _ in range(200)]
    assert codes_of(frame(spark, rows)) == plain_codes(rows)


def test_nearest_entry_is_the_first_of_the_nearest():
    pick = np.random.default_rng(5)
    for width in (1, 2, 4, 16):
        for reach in (2, 5, 1000):
            entries = pick.integers(-reach, reach, (64, width))
            parts = pick.integers(-reach, reach, (500, width))
            apart = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
            index, distance = equal_average.nearest(parts, entries)
            assert (index == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()


def test_bounds_of_components_are_exact():
    limit = equal_average.limit_of(64, 16)
    parts = np.array([[limit] * 4, [-limit] * 4])
    index, distance = equal_average.nearest(parts, np.array([[-limit] * 4, [limit] * 4]))
    assert index.tolist() == [1, 0] and distance.tolist() == [0, 0]
    assert equal_average.nearest(parts[:1], parts[1:])[1].tolist() == [4 * (2 * limit) ** 2]
    assert 64 * (2 * limit) ** 2 < 1 << 63 and 64 * (2 * bit_planes.LIMIT) ** 2 < 1 << 63


def test_codes_decode_to_their_entries(spark):
    rows = vectors(6, 50)
    coded, books = equal_average.compressed(frame(spark, rows))
    found = {r["id"]: r["vector"] for r in equal_average.decoded(coded, books).collect()}
    errors = {r["id"]: r["error"] for r in coded.collect()}
    assert {i: square(whole(v, 256), found[i]) for i, v, _ in rows} == errors


def plain_clusters(rows, clusters=8, rounds=10, scale=1024):
    kept = [(i, w) for i, v, _ in rows if (w := whole(v, scale)) is not None]

    def key(r):
        digest = hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else None
        return digest is None, digest or "", r[1]

    centroids = [w for _, w in sorted(kept, key=key)[:clusters]]
    for _ in range(rounds):
        members = {}
        for _, w in kept:
            members.setdefault(best(w, centroids)[1], []).append(w)
        for k, m in members.items():
            centroids[k] = [sum(x) // len(m) for x in zip(*m)]
    found = [(i, *reversed(best(w, centroids))) for i, w in kept]
    inertia = {k: sum(d for _, c, d in found if c == k) for k in range(clusters)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, k, d, inertia[k], sum(inertia.values()), digest[k]) for i, k, d in found], key=str)


def clusters_of(docs, **settings):
    rows = bit_planes.digests(*bit_planes.clustered(docs, **settings)).collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("seed,n,spread", [(1, 300, 0.3), (2, 5, 0.3), (3, 60, 50.0), (4, 100, 0.0)])
def test_clusters(spark, seed, n, spread):
    rows = vectors(seed, n, spread=spread) + ODD
    assert clusters_of(frame(spark, rows).repartition(3)) == plain_clusters(rows)


def test_clusters_of_tasks_with_other_numbers_of_planes(spark):
    rows = vectors(7, 40, spread=0.01) + [(1000 + i, v, la) for i, v, la in vectors(8, 40, spread=3000.0)] + [(None, [0.5] * 64, 1), (1, [-0.25] * 64, 1)]
    docs = frame(spark, rows[:40]).unionByName(frame(spark, rows[40:]))
    assert clusters_of(docs) == plain_clusters(rows)


def test_planes_give_exact_dot_products():
    pick = np.random.default_rng(1)
    for reach in (1, 7, 1 << 12, bit_planes.LIMIT):
        a, b = (pick.integers(-reach, reach + 1, (50, 64)) for _ in range(2))
        a[0], b[0] = reach, -reach
        planes = bit_planes.planes_of(a)
        assert (bit_planes.components_of(planes) == a).all()
        for row in b[:5]:
            assert (bit_planes.dot_products(planes, bit_planes.planes_of(row[None])[0]) == a @ row).all()


def test_vectors_of_an_empty_table(spark):
    for rows in ([], ODD):
        assert codes_of(frame(spark, rows)) == ([], "")
        assert clusters_of(frame(spark, rows)) == []


def test_columns(spark, folder):
    frame(spark, vectors(1, 10)).write.parquet(f"{folder}/embeddings.parquet")
    codes = queries.QUERIES["op12_equal_average_codes"](spark, folder)
    assert codes.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    clusters = queries.QUERIES["op13_bit_plane_clusters"](spark, folder)
    kinds = ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert clusters.dtypes == list(zip(["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"], kinds))
