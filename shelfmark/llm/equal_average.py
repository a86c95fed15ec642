"""Vectors compressed to codes by a codebook for each part, its nearest entry found by equal-average search.

The entries of a codebook are sorted by the sum of their components. The search for a part starts where the part's own sum
would stand and goes outward both ways. The square of the gap between two sums, over the number of components, is at most
the squared distance, so a side ends as soon as that bound is strictly greater than the best distance: an entry that only
equals it may still win by its lower index.

All numbers are whole and exact in 64 bits. For that, components are bounded: see `limit_of`.
"""

from __future__ import annotations

from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import arrow_map, record_batch
from shelfmark.llm.vectors import rows_of, scaled
from shelfmark.operators.workspace import written


class Settings(NamedTuple):
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


#: One codebook of (entries, components of a part) for each part.
Codebooks = np.ndarray


def limit_of(dims: int, parts: int) -> int:
    """The largest size of a scaled component for which distances and squared gaps of sums are exact in 64 bits."""
    return min(isqrt((1 << 61) // dims) // 2, (1 << 30) // (dims // parts))


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, settings: Settings) -> tuple[DataFrame, int]:
    """(id, label, dims, ints) of the vectors that can be coded, as a written table, and their length.

    Left out are vectors that are null, hold a null or non-finite component or one beyond `limit_of` (a component beyond
    370 000 for 64 of them in 16 parts and a scale of 256), those that cannot be cut into equal parts, and those of another length than the one
    with the smallest id."""
    label = F.col(f"`{label_col}`") if label_col else None
    rows = rows_of(vectors, id_col, vector_col, label)
    kinds = dict(rows.dtypes)
    ddl = f"id {kinds['id']}, label {kinds['label']}, dims int, ints binary"

    def run(batches):
        for b in batches:
            at, lengths, whole = scaled(b.column(2), settings.scale)
            starts = np.cumsum(lengths) - lengths
            keep, ints = [], []
            for length in np.unique(lengths).tolist():
                if not length or length % settings.parts:
                    continue
                own = np.flatnonzero(lengths == length)
                block = whole[starts[own][:, None] + np.arange(length)]
                fits = np.abs(block).max(axis=1) <= limit_of(length, settings.parts)
                raw, width = block[fits].astype("<i4").tobytes(), 4 * length
                ints += [raw[k : k + width] for k in range(0, len(raw), width)]
                keep += own[fits].tolist()
            chosen = b.select([0, 1]).take(pa.array(at[keep]))
            schema = pa.schema([*chosen.schema, ("dims", pa.int32()), ("ints", pa.binary())])
            yield record_batch(schema, *chosen.columns, lengths[keep], ints)

    table = written(arrow_map(rows, run, ddl), "integers")
    first = table.orderBy(F.col("id").asc_nulls_last(), "ints").select("dims").first()
    dims = first["dims"] if first else settings.parts
    return table.where(F.col("dims") == dims), dims


def as_rows(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<i4").astype(np.int64).reshape(len(raw), -1)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for each part, ties to the lower index."""
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, entries = sums[order], entries[order]
    own, width = parts.sum(axis=1), parts.shape[1]
    best = np.full(len(parts), np.iinfo(np.int64).max // width)
    index = np.zeros(len(parts), np.int64)
    start = np.searchsorted(sums, own)
    sides = [(1, np.arange(len(parts)), start), (-1, np.arange(len(parts)), start - 1)]
    while any(len(rows) for _, rows, _ in sides):
        for side, (step, rows, at) in enumerate(sides):
            inside = (at >= 0) & (at < len(sums))
            rows, at = rows[inside], at[inside]
            gap = sums[at] - own[rows]
            open_ = gap * gap <= best[rows] * width  # beyond it nothing on this side can win or tie
            rows, at = rows[open_], at[open_]
            apart = parts[rows] - entries[at]
            distance = (apart * apart).sum(axis=1)
            wins = (distance < best[rows]) | ((distance == best[rows]) & (order[at] < index[rows]))
            best[rows[wins]], index[rows[wins]] = distance[wins], order[at[wins]]
            sides[side] = (step, rows, at + step)
    return index, best


def assigned(vectors: np.ndarray, codebooks: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """The codes of vectors, a column for each part, and the squared distances of their parts."""
    cut = vectors.reshape(len(vectors), len(codebooks), -1)
    found = [nearest(cut[:, p], book) for p, book in enumerate(codebooks)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])


def improved(table: DataFrame, codebooks: Codebooks) -> Codebooks:
    """Every used entry becomes the componentwise floor of the mean of its parts. Tasks sum up first; what reaches the driver
    is as large as the codebooks."""
    shape = codebooks.shape

    def run(batches):
        totals, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for b in batches:
            vectors = as_rows(b.column(0)) if b.num_rows else np.zeros((0, shape[0] * shape[2]), np.int64)
            codes, _ = assigned(vectors, codebooks)
            cut = vectors.reshape(len(vectors), shape[0], shape[2])
            for p in range(shape[0]):
                np.add.at(totals[p], codes[:, p], cut[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=shape[1])
        part, entry = np.nonzero(counts)
        width = shape[2]
        yield record_batch(
            SUMS, np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)),
            totals[part, entry].reshape(-1), np.repeat(counts[part, entry], width),
        )

    sums = arrow_map(table.select("ints"), run, "part int, entry int, place int, total long, n long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "n")]
    out = codebooks.copy()
    for r in sums.groupBy("part", "entry", "place").agg(*exact).collect():
        out[r["part"], r["entry"], r["place"]] = int(r["total"]) // int(r["n"])
    return out


def learned(table: DataFrame, dims: int, settings: Settings) -> Codebooks:
    """Codebooks that start as the parts of the vectors with the smallest ids and are improved for the given rounds. Rows that
    repeat an id count each, in the order of their components; null ids come last."""
    first = table.orderBy(F.col("id").asc_nulls_last(), "ints").limit(settings.entries).select("ints").collect()
    start = np.array([np.frombuffer(r["ints"], "<i4") for r in first], np.int64).reshape(len(first), settings.parts, dims // settings.parts)
    codebooks = np.ascontiguousarray(start.transpose(1, 0, 2))
    for _ in range(settings.rounds if first else 0):
        codebooks = improved(table, codebooks)
    return codebooks


def encoded(table: DataFrame, codebooks: Codebooks) -> DataFrame:
    """(id, label, code, error): a byte for each part, and the squared distances summed over the parts."""
    kinds = dict(table.dtypes)

    def run(batches):
        for b in batches:
            if b.num_rows:
                codes, errors = assigned(as_rows(b.column(2)), codebooks)
                raw, width = codes.astype(np.uint8).tobytes(), codes.shape[1]
                code = [raw[at : at + width] for at in range(0, len(raw), width)]
                schema = pa.schema([*b.schema.remove(2), ("code", pa.binary()), ("error", pa.int64())])
                yield record_batch(schema, b.column(0), b.column(1), code, errors.sum(axis=1))

    ddl = f"id {kinds['id']}, label {kinds['label']}, code binary, error long"
    return arrow_map(table.select("id", "label", "ints"), run, ddl)


def decoded(coded: DataFrame, codebooks: Codebooks) -> DataFrame:
    """(id, vector): the scaled integers that the codes stand for."""

    def run(batches):
        schema = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.int64()))])
        for b in batches:
            codes = [np.frombuffer(c, np.uint8) for c in b.column(1).to_pylist()]
            parts = [np.concatenate([book[c] for book, c in zip(codebooks, code)]) for code in codes]
            yield record_batch(schema, b.column(0), parts)

    return arrow_map(coded.select(F.col("id").cast("long"), "code"), run, "id long, vector array<long>")


def joined(codebooks: Codebooks) -> str:
    """All components of all entries, by part, entry and place, as decimal numbers with commas between."""
    return ",".join(map(str, codebooks.reshape(-1).tolist()))


def compressed(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", settings: Settings = Settings()
) -> tuple[DataFrame, Codebooks]:
    """(id, label, code, error, label_error) of every vector that can be coded, and the codebooks.

    label_error sums the errors of all rows of the label, null labels together; where it does not fit a long it is null. Null
    vectors and others that `integers` names are left out, rows that repeat an id are coded each, and an empty table gives an
    empty one. With fewer vectors than entries the codebooks have so many entries only."""
    if not 0 < settings.entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    table, dims = integers(vectors, id_col, vector_col, label_col, settings)
    codebooks = learned(table, dims, settings)
    coded = written(encoded(table, codebooks), "coded")
    # written too, so that its size is known when the join is planned; a hot label is split by the shuffle of the other side
    labels = coded.groupBy("label").agg(F.expr("try_cast(sum(cast(error as decimal(38,0))) as long)").alias("label_error"))
    labels = written(labels.withColumnRenamed("label", "_label"), "labels")
    rows = coded.join(labels, coded["label"].eqNullSafe(labels["_label"])).drop("_label")
    return rows, codebooks
