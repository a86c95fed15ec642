"""Centroid clustering of vectors of 64 components on bit planes.

A scaled component is a whole number in two's complement. The bits of one weight of all 64 components are one 64-bit word,
a plane. The dot product of two vectors is the sum, over all pairs of their planes, of the number of bits set in both times
the two weights, where the last plane of each has a negative weight: exact in 64 bits, and so are squared distances, which
are two lengths less twice the dot product.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import arrow_map, record_batch
from shelfmark.llm.vectors import rows_of, scaled
from shelfmark.operators.workspace import written

#: Components of a vector: one for each bit of a plane.
WIDTH = 64
#: Largest size of a scaled component: squared distances stay exact in 64 bits.
LIMIT = 1 << 26
#: Vectors compared with all centroids in one go.
ROWS = 4096


def planes_of(vectors: np.ndarray) -> np.ndarray:
    """A row of planes for each vector, lowest bit first, the sign last, as many as the largest component needs."""
    top = int(max(vectors.max(initial=0), -vectors.min(initial=0) - 1))
    weights = np.arange(top.bit_length() + 1, dtype=np.int64)
    bits = (vectors[:, None, :] >> weights[None, :, None] & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0]


def components_of(planes: np.ndarray) -> np.ndarray:
    """The vectors that have these planes."""
    bits = np.unpackbits(np.ascontiguousarray(planes, "<u8")[:, :, None].view(np.uint8), axis=2, bitorder="little")
    return (bits.astype(np.int64) * weights_of(planes.shape[1])[None, :, None]).sum(axis=1)


def weights_of(planes: int) -> np.ndarray:
    weights = np.int64(1) << np.arange(planes, dtype=np.int64)
    weights[-1] = -weights[-1]
    return weights


def dot_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of every row of planes on the left with the one row of planes on the right."""
    weights, others = weights_of(left.shape[1]), weights_of(len(right))
    out = np.zeros(len(left), np.int64)
    for plane, weight in zip(right, others):
        if plane:
            out += weight * (np.bitwise_count(left & plane).astype(np.int64) @ weights)
    return out


def nearest(planes: np.ndarray, squares: np.ndarray, centroids: list[np.ndarray], lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid for every vector, ties to the smaller number."""
    index, best = np.zeros(len(planes), np.int64), np.full(len(planes), np.iinfo(np.int64).max)
    for number, (centroid, length) in enumerate(zip(centroids, lengths)):
        distance = squares + length - 2 * dot_products(planes, centroid)
        wins = distance < best
        index[wins], best[wins] = number, distance[wins]
    return index, best


PACKED = "planes binary, square long"


def packed(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, planes, square) as a written table, square the squared length. Left out are vectors that are null, have another
    number of components than 64, or hold a component that is null, non-finite or beyond LIMIT when scaled."""
    rows = rows_of(vectors, id_col, vector_col)

    def run(batches):
        for b in batches:
            at, lengths, whole = scaled(b.column(1), scale)
            row_of = np.repeat(np.arange(len(at)), lengths)
            fits = lengths == WIDTH
            fits[row_of[np.abs(whole) > LIMIT]] = False
            ints = whole[fits[row_of]].astype(np.int64).reshape(-1, WIDTH)
            ids = b.column(0).take(pa.array(at[fits]))
            schema = pa.schema([("id", ids.type), ("planes", pa.binary()), ("square", pa.int64())])
            for k in range(0, len(ints), ROWS):
                planes = planes_of(ints[k : k + ROWS])
                raw, width = planes.tobytes(), 8 * planes.shape[1]
                binary = [raw[p : p + width] for p in range(0, len(raw), width)]
                yield record_batch(schema, ids.slice(k, ROWS), binary, (ints[k : k + ROWS] ** 2).sum(axis=1))

    return written(arrow_map(rows.select("id", "vector"), run, f"id {dict(rows.dtypes)['id']}, {PACKED}"), "planes")


def groups_of(batch: pa.RecordBatch):
    """(rows, planes, squares) of a batch, apart by the number of planes, which may differ between parts of a table."""
    raw, squares = batch.column("planes").to_pylist(), batch.column("square").to_numpy()
    widths = np.array([len(r) for r in raw], np.int64)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            planes = np.frombuffer(b"".join(raw[r] for r in some), "<u8").reshape(len(some), -1)
            yield some, planes, squares[some]


class Centroids:
    """Centroids as whole numbers, with their planes and squared lengths."""

    def __init__(self, vectors: list[list[int]]):
        self.vectors = vectors
        self.planes = [planes_of(np.array([v], np.int64))[0] for v in vectors]
        self.lengths = [sum(x * x for x in v) for v in vectors]

    def nearest(self, planes: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(planes, squares, self.planes, self.lengths)


SUMS = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])


def summed(table: DataFrame, centroids: Centroids) -> DataFrame:
    """(cluster, place, total, n): sums of components by cluster, and of distances at place 64. Tasks sum up first, so
    there are few rows however many vectors a cluster has."""
    count = len(centroids.vectors)

    def run(batches):
        totals, counts = np.zeros((count, WIDTH + 1), np.int64), np.zeros(count, np.int64)
        for b in batches:
            for _, planes, squares in groups_of(b):
                cluster, distance = centroids.nearest(planes, squares)
                ones = np.unpackbits(np.ascontiguousarray(planes)[:, :, None].view(np.uint8), axis=2, bitorder="little")
                for number in np.unique(cluster):
                    own = cluster == number
                    of_bits = ones[own].sum(axis=0, dtype=np.int64)
                    totals[number, :WIDTH] += weights_of(planes.shape[1]) @ of_bits
                    totals[number, WIDTH] += distance[own].sum()
                    counts[number] += own.sum()
        used = np.flatnonzero(counts)
        places = WIDTH + 1
        yield record_batch(SUMS, np.repeat(used, places), np.tile(np.arange(places), len(used)), totals[used].reshape(-1), np.repeat(counts[used], places))

    sums = arrow_map(table.select("planes", "square"), run, "cluster int, place int, total long, n long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "n")]
    return sums.groupBy("cluster", "place").agg(*exact)


def learned(table: DataFrame, clusters: int, rounds: int, salt: str) -> Centroids:
    """Centroids that start as the vectors with the smallest hashes of salt and id, and become the floor of the mean of
    their vectors in each round; empty ones stay. Rows that repeat an id count each, in the order of their planes; null ids
    come last."""
    key = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = table.orderBy(key.asc_nulls_last(), "planes").limit(clusters).select("planes").collect()
    start = [components_of(np.frombuffer(r["planes"], "<u8")[None, :])[0].tolist() for r in first]
    centroids = Centroids(start)
    for _ in range(rounds if first else 0):
        vectors = [list(v) for v in centroids.vectors]
        for r in summed(table, centroids).where(F.col("place") < WIDTH).collect():
            vectors[r["cluster"]][r["place"]] = int(r["total"]) // int(r["n"])
        centroids = Centroids(vectors)
    return centroids


def assigned(table: DataFrame, centroids: Centroids) -> DataFrame:
    """(id, cluster, distance) of every row, distance squared."""

    def run(batches):
        for b in batches:
            cluster, distance = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64)
            for rows, planes, squares in groups_of(b):
                cluster[rows], distance[rows] = centroids.nearest(planes, squares)
            schema = pa.schema([b.schema.field("id"), ("cluster", pa.int32()), ("distance", pa.int64())])
            yield record_batch(schema, b.column("id"), cluster, distance)

    return arrow_map(table, run, f"id {dict(table.dtypes)['id']}, cluster int, distance long")


def clustered(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = 8, rounds: int = 10, scale: int = 1024, salt: str = "3:"
) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, distance) of every vector that `packed` keeps, and (cluster, centroid, n, inertia): the centroid's
    components, its number of vectors and the sum of their squared distances, null where it does not fit a long.

    With fewer vectors than clusters there are so many clusters only; an empty table gives empty ones. Centroids and their
    sums are the only things that reach the driver."""
    table = packed(vectors, id_col, vector_col, scale)
    centroids = learned(table, clusters, rounds, salt)
    found = {r["cluster"]: r for r in summed(table, centroids).where(F.col("place") == WIDTH).collect()}
    rows = []
    for number, v in enumerate(centroids.vectors):
        total, n = (int(found[number][c]) if number in found else 0 for c in ("total", "n"))
        rows.append((number, v, n, total if total < 1 << 63 else None))
    table_of = vectors.sparkSession.createDataFrame(rows, "cluster int, centroid array<long>, n long, inertia long")
    return assigned(table, centroids), table_of


def digests(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """One row for each vector, with the inertia of its cluster and of all and a hash of its cluster's centroid."""
    known = {r["cluster"]: r for r in centroids.collect()}  # as many rows as clusters
    whole = [r["inertia"] for r in known.values()]
    inertia = sum(whole) if None not in whole and sum(whole) < 1 << 63 else None
    inertia_of, hash_of = F.lit(None).cast("long"), F.lit(None).cast("string")
    for number, r in known.items():
        digest = hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest()
        own = F.col("cluster") == number
        inertia_of = F.when(own, F.lit(r["inertia"]).cast("long")).otherwise(inertia_of)
        hash_of = F.when(own, F.lit(digest)).otherwise(hash_of)
    return rows.select(
        F.col("id").alias("vec_id"), "cluster", "distance", inertia_of.alias("cluster_inertia"), F.lit(inertia).cast("long").alias("inertia"), hash_of.alias("centroid_sha256")
    )
