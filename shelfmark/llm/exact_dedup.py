"""Exact deduplication by Grace hashing, as a recursion of Spark jobs.

Equal texts are those with the same bytes once A-Z are lower case. Every scan task first puts the contents it meets
into an open-addressing table, so that copies cross the network once for each task. The distinct contents are then
partitioned by hash; each partition fills a table of bounded size. What does not fit is written to spill files in
the shared folder and partitioned again by another hash, until nothing is left over. Tables compare complete
contents; hashes only choose partitions and slots.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import arrow_column, arrow_map, id_and_text, record_batch, slices
from shelfmark.operators.workspace import written

#: Bytes of content a table holds; one content of any length always fits.
TABLE_BYTES = 64 << 20


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case, nothing else changed; a null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def content_hash(content: bytes) -> int:
    return xxhash.xxh3_64_intdigest(content) - (1 << 63)


class ContentTable:
    """Open addressing with linear probing over complete contents; keeps the largest id, how many rows have
    it, and the number of rows of each content."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.slots = array("q", [-1]) * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.top: list[int | None] = []
        self.tops: list[int] = []
        self.rows: list[int] = []
        self.bytes = 0

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        slots = array("q", [-1]) * (mask + 1)
        for entry, h in enumerate(self.hashes):
            i = h & mask
            while slots[i] >= 0:
                i = (i + 1) & mask
            slots[i] = entry
        self.slots = slots

    def add(self, h: int, content: bytes, top: int | None, tops: int, rows: int) -> bool:
        """False if the content is new and there is no room for it."""
        slots, mask = self.slots, len(self.slots) - 1
        i = h & mask
        while (entry := slots[i]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                held = self.top[entry]
                if held == top:
                    self.tops[entry] += tops
                elif held is None or (top is not None and top > held):
                    self.top[entry], self.tops[entry] = top, tops
                self.rows[entry] += rows
                return True
            i = (i + 1) & mask
        if self.contents and self.bytes + len(content) > self.limit:
            return False
        slots[i] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.top.append(top)
        self.tops.append(tops)
        self.rows.append(rows)
        self.bytes += len(content) + 200
        if 3 * len(self.contents) > 2 * len(slots):
            self._grow()
        return True


ENTRY = pa.schema(
    [("h", pa.int64()), ("content", pa.binary()), ("top", pa.int64()), ("tops", pa.int64()), ("rows", pa.int64())]
)
LEVEL = pa.schema([("digest", pa.binary()), *ENTRY])
ENTRY_DDL = "h long, content binary, top long, tops long, rows long"


def _entries(table: ContentTable) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(table.contents), 256):
        cut = slice(at, at + 256)
        yield record_batch(ENTRY, table.hashes[cut], table.contents[cut], table.top[cut], table.tops[cut], table.rows[cut])


def local_contents(docs: DataFrame, table_bytes: int, hash_of: Callable[[bytes], int]) -> DataFrame:
    """The distinct contents of each scan task, or of each tableful of it."""

    def run(batches):
        table = ContentTable(table_bytes)
        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                content = normalised(text)
                entry = (hash_of(content), content, doc, 1, 1)
                if not table.add(*entry):
                    yield from _entries(table)
                    table = ContentTable(table_bytes)
                    table.add(*entry)
        yield from _entries(table)

    return arrow_map(docs, run, ENTRY_DDL)


def one_level(entries: DataFrame, table_bytes: int) -> DataFrame:
    """Finished contents with their digest, without the content itself, and with it those that found no room.

    A content in the table has met all its copies, since every later one finds it there; one that has not found
    room has no copy in the table.
    """

    def run(batches):
        table = ContentTable(table_bytes)
        for b in slices(batches):
            left = [e for e in zip(*(c.to_pylist() for c in b.columns)) if not table.add(*e)]
            if left:
                yield record_batch(LEVEL, [None] * len(left), *(list(c) for c in zip(*left)))
        for b in _entries(table):
            digests = [hashlib.sha256(c).digest() for c in b.column(1).to_pylist()]
            yield record_batch(LEVEL, digests, b.column(0), [None] * b.num_rows, *b.columns[2:])

    return arrow_map(entries, run, f"digest binary, {ENTRY_DDL}")


def content_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    table_bytes: int = TABLE_BYTES,
    hash_of: Callable[[bytes], int] = content_hash,
) -> DataFrame:
    """(digest, top, tops, rows) of every distinct content: SHA-256 of its bytes, the largest id, the number of rows that
    have it and of all rows. Ids may be null; a content with none but null ids has a null top."""
    ids = id_and_text(docs, id_col, text_col)
    spark = docs.sparkSession
    size = ids.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    entries, done = local_contents(ids, table_bytes, hash_of), []
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        n = max(least, -(-2 * size // table_bytes))
        dealt = entries.repartition(n, F.xxhash64("h", F.lit(len(done))))
        level = written(one_level(dealt, table_bytes), "contents")
        done.append(level.where("digest is not null").select("digest", "top", "tops", "rows"))
        spilled = level.where("digest is null").select("h", "content", "top", "tops", "rows")
        size, least = spilled.agg(F.sum(F.octet_length("content"))).first()[0], 1
        if size is None:
            break
        entries = spilled
    groups = done[0]
    for more in done[1:]:
        groups = groups.unionByName(more)
    return groups


def digest_of(text_col: str):
    """SHA-256 of the normalised text, as a column."""

    def digests(column: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(normalised(t)).digest() for t in column.to_pylist()], pa.binary())

    return arrow_column(digests, "binary", F.col(f"`{text_col}`").cast("string"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Of equal texts the row with the largest id stays; null ids are less than all others. A row that repeats an id
    together with its text counts as a row of the group and is marked like the first. A null text is empty.
    """
    groups = content_groups(docs, id_col, text_col, **settings)
    rows = id_and_text(docs, id_col, text_col).select("id", digest_of("text").alias("digest"))
    return rows.join(groups, "digest").select(
        F.col("id").alias("doc_id"),
        F.col("top").alias("keep_id"),
        F.col("rows").alias("group_size"),
        F.col("id").eqNullSafe(F.col("top")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """All columns of one row of each group of equal texts, the one with the largest id; of rows that repeat this id
    with this text, the one with the greatest text (before lower-casing) stays."""
    groups = content_groups(docs, id_col, text_col, **settings)
    digest = "_digest"
    while digest in docs.columns:
        digest = "_" + digest
    keyed = docs.withColumn(digest, digest_of(text_col))

    def winners(g: DataFrame, how: str) -> DataFrame:
        g = g.select(F.col("digest").alias("_g_digest"), F.col("top").alias("_g_top"))
        same = (keyed[digest] == g["_g_digest"]) & keyed[f"`{id_col}`"].eqNullSafe(g["_g_top"])
        return keyed.join(g, same, how)

    single = winners(groups.where("tops = 1"), "left_semi").drop(digest)
    repeated = groups.where("tops > 1")
    if repeated.isEmpty():
        return single
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    best = F.max_by(row, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    again = winners(repeated, "left_semi").groupBy(digest).agg(best.alias("row")).select("row.*")
    return single.unionByName(again)
