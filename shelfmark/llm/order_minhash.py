"""Order MinHash fingerprints: sensitive to edit distance, not only to shared content.

Every k-mer of a text is numbered by its occurrence. Each of several hash functions selects the few k-mers of least
hash, which are put back into text order; the hash of that tuple is one component of the fingerprint. Two texts
agree in a component about as often as they share these k-mers in this order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import arrow_column, arrow_map, record_batch, slices

#: Code points of a k-mer (a power of two), components of a fingerprint, k-mers in a component.
K, COMPONENTS, CHOSEN = 8, 32, 2
#: Hash values held at a time.
CELLS = 1 << 18

_BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: Odd multipliers, one hash function each: the order of (hash * multiplier) mod 2^32.
MULTIPLIERS = (mixed(np.arange(1, COMPONENTS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def kmer_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of each window of k code points; the whole text if it is shorter."""
    h = mixed(codes.astype(np.uint64) + np.uint64(1))
    if len(h) < k:
        total = len(h)
        for x in h.tolist():
            total = (total * _BASE + x) % (1 << 64)
        return mixed(np.array([total], np.uint64)) if len(h) else h
    factor, width = _BASE, 1
    while width < k:  # windows of 2, 4, 8 ...
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % (1 << 64), 2 * width
    return mixed(h)


def numbered(h: np.ndarray) -> np.ndarray:
    """32-bit hashes of (k-mer, its how-manieth occurrence in the text).

    One sort of words that hold the upper bits of a k-mer's hash above its place brings equal ones together in text order.
    """
    n = len(h)
    bits = np.uint64(max(1, n.bit_length()))
    places = np.arange(n, dtype=np.uint64)
    words = (h >> bits << bits) | places
    words.sort()
    order = (words & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ranked = words >> bits
    again = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
    out = h.copy()
    if len(again):  # runs of repeats: how far each is from the start of its run
        first = np.ones(n, bool)
        first[again] = False
        starts = np.flatnonzero(first)
        times = (again - starts[np.searchsorted(starts, again, side="right") - 1]).astype(np.uint64)
        out[order[again]] = mixed(h[order[again]] + times * np.uint64(_BASE))
    return (out >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str) -> np.ndarray:
    """COMPONENTS 16-bit numbers; all zero for an empty text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(COMPONENTS, np.uint16)
    if not len(codes):
        return out
    h = kmer_hashes(codes)
    g = numbered(h)
    n = len(g)
    rows = max(1, min(COMPONENTS, CELLS // n))
    for at in range(0, COMPONENTS, rows):
        grid = g[None, :] * MULTIPLIERS[at : at + rows, None]
        line = np.arange(len(grid))
        places = np.empty((len(grid), min(CHOSEN, n)), np.int64)
        for j in range(places.shape[1]):
            places[:, j] = least = grid.argmin(axis=1)
            grid[line, least] = np.uint32(0xFFFFFFFF)
        places.sort(axis=1)
        sign = np.full(len(grid), 1, np.uint64)
        for j in range(places.shape[1]):
            sign = mixed(sign * np.uint64(_BASE) + g[places[:, j]])
        out[at : at + rows] = (sign >> np.uint64(48)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal components, 0 to 1."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the start of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as array of COMPONENTS numbers) of every row; a null text is empty, a null id stays null, rows that
    repeat have a row each, and an empty table gives an empty one."""
    schema = pa.schema([("id", pa.int64()), ("fingerprint", pa.list_(pa.int32()))])

    def run(batches):
        for b in slices(batches):
            found = [fingerprint(t or "").astype(np.int32) for t in b.column(1).to_pylist()]
            yield record_batch(schema, b.column(0), found)

    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return arrow_map(docs, run, "id long, fingerprint array<int>")


def text_of(fp: np.ndarray) -> str:
    return fp.astype(">u2").tobytes().hex()


def neighbours(docs: DataFrame, partitions: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, guest, id, text), sorted within partitions: every row in a block of neighbouring ids, and in each
    block as guest the row that follows its last one, in the last block the first row of all.

    The texts are shuffled once. What the driver holds is one border and one first id for each block.
    """
    docs = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("id"),  # a null id comes first
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    n = 4 * partitions
    cuts = sorted(set(docs.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []

    def block(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, ids.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    placed = docs.withColumn("block", arrow_column(block, "int", "id"))
    firsts = sorted((r["block"], r["first"]) for r in placed.groupBy("block").agg(F.min("id").alias("first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}  # -1: the last block

    def host(ids: pa.Array) -> pa.Array:
        return pa.array([before.get(i) for i in ids.to_pylist()], pa.int32())

    seats = F.array(F.struct("block", F.lit(False).alias("guest")), F.struct(F.col("host").alias("block"), F.lit(True).alias("guest")))
    seated = placed.withColumn("host", arrow_column(host, "int", "id")).select("id", "text", F.explode(seats).alias("seat"))
    seated = seated.where("seat.block is not null").select("seat.block", "seat.guest", "id", "text")
    return seated.repartition(partitions, "block").sortWithinPartitions("block", "guest", "id", "text")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row the fingerprints of its text and of its edited text, and how like the former is to the latter's
    and to the next row's, in ascending order of id (then text); the first row follows the last.

    A null text is empty. Repeated rows follow each other. A null id counts as the least long (-2^63) and stays
    null, so that number itself is no id of its own.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        block = last = None  # last: id, text and fingerprint of the row that waits for the next one
        for b in slices(batches):
            out = []
            for at, guest, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                if at != block:
                    block, last = at, None
                if guest and last is None:
                    continue  # the block has its guest already
                fp = fingerprint(text)
                if last is not None:
                    own, before, print_ = last
                    new = edited(before, text)
                    other = fingerprint(new) if new != before else print_
                    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    doc_id = None if own == -(1 << 63) else own
                    out.append((doc_id, len(before), sha, text_of(print_), text_of(other), likeness(print_, other), likeness(print_, fp)))
                last = None if guest else (doc, text, fp)
            if out:
                yield record_batch(RESULT, *(list(c) for c in zip(*out)))

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return arrow_map(neighbours(docs, partitions, id_col, text_col), run, schema)
