"""Repeated passages of words, found by anchors on fixed blocks.

Every document is cut into reference blocks of `block` words that do not overlap, and these are the index. Every rolling
window of as many words, of every document, is a probe. Of a window of 2 * block - 1 words or more one reference block lies
wholly inside, so of two equal windows each holds an anchor: a place where a probe hits a block that stands elsewhere. Only
windows around anchors go on. They are extended to whole windows, told apart by 128-bit hashes of their words, and those
that start earlier elsewhere are repeats; those that adjoin join to maximal repeats.

Documents are gathered in lots of bounded size. A lot sends every bucket of hashes one message with its distinct hashes, however
often they occur in it, and gets back one bit for each; so a passage that stands in a third of all documents is one entry for
each lot, and no pair of occurrences is ever made. The texts of a lot are written once, bucketed by lot, and never shuffled again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import arrow_map, give_back, id_and_text, record_batch, ship, slices
from shelfmark.operators.workspace import new_dir, written

#: Words of a lot, and entries of a bucket, about.
LOT, BUCKET = 1 << 18, 1 << 21

LOTS = pa.schema([("lot", pa.int64()), ("words", pa.int64()), ("body", pa.binary())])
MESSAGES = pa.schema([("bucket", pa.int64()), ("lot", pa.int64()), ("entries", pa.int64()), ("body", pa.binary())])
MARKS = pa.schema([("lot", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])
MARKS_DDL = "lot long, bucket long, bits binary"


def lots(docs: DataFrame, size: int) -> DataFrame:
    """(lot, words, body): documents (id, text) of about so many words in one compressed row, bucketed by lot. A document
    is never cut. Within a lot documents are in order: by id, null ids last, then by the hash of the text."""

    def run(batches):
        number, held, words = TaskContext.get().partitionId() << 32, [], 0

        def row():
            rows = sorted(((i is None, i, text_hash(t), t) for i, t in held), key=lambda r: (r[0], r[1] or 0, r[2]))
            body = pa.record_batch([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.large_binary())], ["id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(body)
            return record_batch(LOTS, [number], [words], [sink.getvalue().to_pybytes()])

        for b in slices(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = (t or "").encode("utf-8", "surrogatepass")
                held.append((i, text))
                words += len(text.split())
                if words >= size:
                    yield row()
                    number, held, words = number + 1, [], 0
        if held:
            yield row()

    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = arrow_map(docs.select(F.col("id").cast("long").alias("id"), "text"), run, "lot long, words long, body binary")
    name = f"lots_{uuid.uuid4().hex}"
    made.write.bucketBy(buckets, "lot").option("path", new_dir(spark, "lots")).saveAsTable(name)
    return spark.table(name)


def text_hash(text: bytes) -> int:
    return xxhash.xxh32_intdigest(text)


class Lot:
    """The words of a lot one after the other, as indexes of distinct words with two hashes each."""

    def __init__(self, body: bytes):
        table = pa.ipc.open_stream(pa.py_buffer(body)).read_all()
        self.ids = table.column("id").to_pylist()
        texts = table.column("text").to_pylist()
        self.hashes = [text_hash(t) for t in texts]
        self.words = [t.split() for t in texts]  # bytes split at exactly \x20, \x09-\x0D
        seen: dict[bytes, int] = {}
        index = seen.setdefault
        self.flat = np.fromiter((index(w, len(seen)) for words in self.words for w in words), np.int64)
        raw = b"".join(map(xxhash.xxh128_digest, seen))
        self.low, self.high = np.frombuffer(raw, "<u8").reshape(-1, 2).T if seen else np.zeros((2, 0), np.uint64)
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.doc = np.repeat(np.arange(len(lengths)), lengths)  # of every word, like the next two
        self.place = np.arange(len(self.flat)) - self.starts[self.doc]
        self.left = lengths[self.doc] - self.place

    def window_hashes(self, hashes: np.ndarray, words: int, seed: int) -> np.ndarray:
        """A hash of the words from every place on; without meaning where fewer are left in the document."""
        factors = np.random.default_rng(seed).integers(0, 1 << 63, words, np.uint64) * np.uint64(2) + np.uint64(1)
        of_words, out = hashes[self.flat], np.zeros(len(self.flat), np.uint64)
        for k, factor in enumerate(factors[: max(0, len(out))]):
            out[: len(out) - k] += of_words[k:] * factor
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x9E3779B97F4A7C15)
        return out ^ (out >> np.uint64(29))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def planes(values: np.ndarray, width: int) -> bytes:
    """The lower bytes of numbers, byte by byte, which compresses well where they are sorted or small."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(raw: bytes, at: int, count: int, width: int) -> tuple[np.ndarray, int]:
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, count * width, at).reshape(width, count).T
    return out.view("<u8")[:, 0], at + count * width


class Anchors:
    """The distinct hashes of a lot's probes, by bucket, and whether they stand at a block or more than once."""

    def __init__(self, lot: Lot, block: int, buckets: int):
        self.at = np.flatnonzero(lot.left >= block)
        found = lot.window_hashes(lot.low, block, block)[self.at]
        distinct, self.entry, counts = np.unique(found, return_inverse=True, return_counts=True)
        bucket = bucket_of(distinct, buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.entry = place[self.entry]
        self.hashes, self.bucket, self.again = distinct[order], bucket[order], counts[order] > 1
        self.block = np.zeros(len(order), bool)
        self.block[self.entry[lot.place[self.at] % block == 0]] = True

    def messages(self, number: int) -> Iterator[pa.RecordBatch]:
        for bucket, a, b in ranges(self.bucket):
            body = planes(self.hashes[a:b], 5) + np.packbits(self.block[a:b]).tobytes() + np.packbits(self.again[a:b]).tobytes()
            yield record_batch(MESSAGES, [bucket], [number], [b - a], [body])


def ranges(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of the runs of sorted values."""
    if not len(values):
        return []
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return [(int(values[a]), a, b) for a, b in zip(cuts, cuts[1:])]


def placed(marks: list[dict] | None, buckets: np.ndarray) -> np.ndarray:
    """The bits that buckets gave back, for the entries of a lot."""
    bits = {m["bucket"]: m["bits"] for m in marks or []}
    out = np.zeros(len(buckets), bool)
    for bucket, a, b in ranges(buckets):
        if bucket in bits:
            out[a:b] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=b - a)
    return out


def hits(numbers: list[int], counts: list[int], bodies: list[bytes]) -> list[np.ndarray]:
    """For each message of a bucket which of its hashes are anchors: those of a block that stand at two places or more."""
    hashes, block, again = [], [], []
    for n, body in zip(counts, bodies):
        found, at = from_planes(body, 0, n, 5)
        size = (n + 7) // 8
        hashes.append(found)
        block.append(np.unpackbits(np.frombuffer(body, np.uint8, size, at), count=n))
        again.append(np.unpackbits(np.frombuffer(body, np.uint8, size, at + size), count=n))
    distinct, entry = np.unique(np.concatenate(hashes), return_inverse=True)
    blocks = np.bincount(entry, np.concatenate(block), len(distinct)) > 0
    places = np.bincount(entry, 1 + np.concatenate(again), len(distinct)) > 1
    return np.split((blocks & places)[entry], np.cumsum(counts)[:-1])


class Extended:
    """The distinct windows around the anchors of a lot, each at its first place, by bucket and place."""

    def __init__(self, lot: Lot, anchors: Anchors, marks: list[dict] | None, window: int, block: int, buckets: int):
        reach = window - block + 1  # an anchor may start so many places after the start of the window
        hit = np.zeros(len(lot.flat) + reach, np.int64)
        hit[anchors.at[placed(marks, anchors.bucket)[anchors.entry]]] = 1
        sums = np.concatenate([[0], np.cumsum(hit)])
        near = sums[reach:][: len(lot.flat)] > sums[: len(lot.flat)]
        self.at = np.flatnonzero(near & (lot.left >= window))
        self.low, self.high, self.bucket = (np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64))
        self.entry = self.first = np.zeros(0, np.int64)
        if len(self.at):
            low = lot.window_hashes(lot.low, window, window)[self.at]
            high = lot.window_hashes(lot.high, window, window + 1)[self.at]
            order = np.lexsort((high, low))  # stable: the first place of a window comes first
            new = np.ones(len(order), bool)
            new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(new) - 1
            first = order[new]
            by = np.lexsort((first, bucket_of(low[first], buckets)))
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            self.entry, self.first = place[group], first[by]
            self.low, self.high = low[self.first], high[self.first]
            self.bucket = bucket_of(self.low, buckets)

    def messages(self, lot: Lot, number: int) -> Iterator[pa.RecordBatch]:
        places = self.at[self.first]
        for bucket, a, b in ranges(self.bucket):
            docs, doc = np.unique(lot.doc[places[a:b]], return_inverse=True)
            ids = [lot.ids[d] for d in docs]
            none = np.array([i is None for i in ids], np.uint8)
            own = np.array([i or 0 for i in ids], np.int64)
            hashes = np.array([lot.hashes[d] for d in docs], np.uint32)
            head = np.array([len(docs)], "<i8").tobytes() + none.tobytes() + planes(own.view(np.uint64), 8) + planes(hashes.astype(np.uint64), 4)
            body = planes(self.low[a:b], 8) + planes(self.high[a:b], 4) + planes(doc.astype(np.uint64), 4)
            starts = lot.place[places[a:b]].astype(np.uint64)
            yield record_batch(MESSAGES, [bucket], [number], [b - a], [head + body + planes(starts, 4)])

    def repeats(self, marks: list[dict] | None) -> np.ndarray:
        """The starts, as places of the lot, of windows that start earlier too: here or, by the marks, in another lot."""
        later = np.ones(len(self.at), bool)
        later[self.first] = placed(marks, self.bucket)
        return self.at[later]


def later(numbers: list[int], counts: list[int], bodies: list[bytes]) -> list[np.ndarray]:
    """For each message of a bucket which of its windows start earlier in another lot."""
    columns: list[list[np.ndarray]] = [[] for _ in range(7)]
    for number, n, body in zip(numbers, counts, bodies):
        docs = int.from_bytes(body[:8], "little")
        none = np.frombuffer(body, np.uint8, docs, 8)
        ids, at = from_planes(body, 8 + docs, docs, 8)
        hashes, at = from_planes(body, at, docs, 4)
        low, at = from_planes(body, at, n, 8)
        high, at = from_planes(body, at, n, 4)
        doc, at = from_planes(body, at, n, 4)
        start, at = from_planes(body, at, n, 4)
        doc = doc.astype(np.int64)
        for column, values in zip(columns, (np.full(n, number), start, hashes[doc], ids[doc].view(np.int64), none[doc], high, low)):
            column.append(values)
    flat = [np.concatenate(c) for c in columns]
    order = np.lexsort(flat)
    high, low = flat[5][order], flat[6][order]
    out = np.zeros(len(order), bool)
    out[order[1:]] = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
    return np.split(out, np.cumsum(counts)[:-1])


def answered(messages: DataFrame, decide) -> DataFrame:
    """(lot, marks) with what each bucket tells each lot about its entries, if anything."""
    ship(messages.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        numbers, buckets = table.column("lot").to_pylist(), table.column("bucket").to_pylist()
        bits = decide(numbers, table.column("entries").to_pylist(), table.column("body").to_pylist())
        rows = [(n, b, np.packbits(x).tobytes()) for n, b, x in zip(numbers, buckets, bits) if x.any()]
        give_back()
        return pa.table([list(c) for c in zip(*rows)] if rows else [[], [], []], MARKS)

    marks = written(messages.groupBy("bucket").applyInArrow(run, MARKS_DDL), "marks")
    return marks.groupBy("lot").agg(F.collect_list(F.struct("bucket", "bits")).alias("marks"))


OUT = pa.schema(
    [
        ("id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
        ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)
OUT_DDL = "id long, text string, n_words long, n_removed long, removed array<struct<start: int, end: int>>"


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, lot_words: int = LOT, bucket_entries: int = BUCKET
) -> DataFrame:
    """(id, text, n_words, n_removed, removed) of every row: its words without those covered by a window of words that also
    starts earlier, joined by one space, and the maximal runs of removed words as [start, end).

    Earlier is: at a smaller id, or earlier in the same document; windows are judged on the input. A null or blank text
    has no word. Ids are whole numbers; null ids come last, rows that repeat an id are in the order of the hashes of their
    texts, and of equal rows any one is first. Shorter documents than a window lose nothing. An empty table gives an empty
    one.
    """
    spark, block = docs.sparkSession, (window + 1) // 2
    table = lots(id_and_text(docs, id_col, text_col), lot_words)
    total = table.agg(F.sum("words")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_entries))

    def probes(batches):
        for number, body in rows_of(batches, 2):
            yield from Anchors(Lot(body), block, buckets).messages(number)

    def windows(batches):
        for number, body, marks in rows_of(batches, 3):
            if marks:
                lot = Lot(body)
                yield from Extended(lot, Anchors(lot, block, buckets), marks, window, block, buckets).messages(lot, number)

    def texts(batches):
        for _, body, marks, late in rows_of(batches, 4):
            lot = Lot(body)
            starts = Extended(lot, Anchors(lot, block, buckets), marks, window, block, buckets).repeats(late) if marks else []
            yield from results(lot, starts, window)

    ddl = "bucket long, lot long, entries long, body binary"
    anchored = answered(arrow_map(table.select("lot", "body"), probes, ddl), hits)
    found = table.select("lot", "body").join(anchored, "lot", "left")
    late = answered(arrow_map(found, windows, ddl), later)
    return arrow_map(found.join(late.withColumnRenamed("marks", "late"), "lot", "left"), texts, OUT_DDL)


def rows_of(batches, columns: int) -> Iterator[tuple]:
    for b in batches:
        for at in range(b.num_rows):
            yield tuple(b.column(c)[at].as_py() for c in range(columns))


def results(lot: Lot, starts, window: int) -> Iterator[pa.RecordBatch]:
    change = np.zeros(len(lot.flat) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.asarray(starts, np.int64) + window, -1)
    gone = np.cumsum(change[:-1]) > 0
    rows: list[tuple] = []
    for n, (i, words) in enumerate(zip(lot.ids, lot.words)):
        own = gone[lot.starts[n] : lot.starts[n] + len(words)]
        spans = []
        if own.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            spans = [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]
            words = [w for w, x in zip(words, own.tolist()) if not x]
        rows.append((i, b" ".join(words).decode("utf-8", "surrogatepass"), len(own), int(own.sum()), spans))
    for at in range(0, len(rows), 1024):
        yield record_batch(OUT, *(list(c) for c in zip(*rows[at : at + 1024])))
