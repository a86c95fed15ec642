"""Best-fit packing of token sequences by hierarchical residual packing.

Pieces are spread by a hash, so that every partition has pieces of all lengths, however the documents lie in files.
Every partition packs its pieces best-fit, largest first. Nearly full bins are done; the others become items of
the next, smaller level, are packed best-fit again, and so on up a tree. Levels hold (bin, fill) pairs
only; places are composed down the tree afterwards. A level ends the tree when one task has packed it, or when
it could not join a hundredth of its bins.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import arrow_map, id_and_text, record_batch, slices, texts
from shelfmark.llm.bpe import blocks
from shelfmark.operators.workspace import written

#: Items packed together in a task at most; a larger partition is packed in several such lots.
LOT = 1 << 20
#: About so many pieces are spread to each partition.
MIX = 1 << 16
#: Levels of the tree join this many partitions into one.
FAN_IN = 8
#: A bin with at most this many free places is done.
NEARLY = 16
#: Fixed value: the split of byte-level BPE files that use their own pattern.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the
    others take the characters from 256 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as the tokenizers library gives them for a byte-level BPE file, as little-endian bytes."""

    def __init__(self, file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = self.by_rank(file)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def by_rank(self, file: str):
        """The encoder of the tiktoken library for the same vocabulary, several times as fast. None unless the file is a
        plain byte-level BPE whose merges are in order of the ids they make, which that library takes for granted."""
        import tiktoken

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        before = spec["pre_tokenizer"] or {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        if (
            spec["normalizer"] is not None
            or (before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) != ("ByteLevel", False, True)
            or model.get("end_of_word_suffix") or model.get("ignore_merges") or made != sorted(made)
        ):
            return None
        byte = {c: b for b, c in byte_characters().items()}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        return tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def encode(self, text: str) -> bytes:
        """Texts with a special string, and all texts where there is no faster way, take the tokenizers library."""
        if self.ranked is None or any(s in text for s in self.special):
            return np.array(self.ids(text), "<u4").tobytes()
        parts = (self.ranked(block, disallowed_special=()) for block in blocks(text))
        return b"".join(ids.astype("<u4", copy=False).tobytes() for ids in parts)


@lru_cache(maxsize=2)
def encoder(file: str) -> Encoder:
    return Encoder(file)


PIECES = pa.schema(
    [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())]
)


def token_pieces(
    docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, piece, start, length, crc) of every text's ids and the end id after them.

    Texts of more than capacity ids are cut so that all pieces but the first are full. A null or empty text is its end
    id alone.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        e = encoder(tokenizer_file)
        for b in slices(batches):
            out = []
            for doc, text in zip(b.column(0).to_pylist(), texts(b, 1)):
                ids = e.encode(text) + end
                n = len(ids) // 4
                at, stop = 0, n if n <= capacity else n % capacity or capacity
                piece = 0
                while at < n:
                    out.append((doc, piece, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])))
                    at, stop, piece = stop, stop + capacity, piece + 1
            yield record_batch(PIECES, *(list(c) for c in zip(*out))) if out else record_batch(PIECES, *[[]] * 5)

    pieces = id_and_text(docs, id_col, text_col)
    return arrow_map(pieces, run, "id long, piece int, start long, length long, crc long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each item, items taken in the given order, and the fill of each bin.

    An item goes to the open bin with the least room that holds it; one bit for each amount of room tells
    which there are.
    """
    bins, places, fills = [], [], []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    for size in sizes.tolist():
        fit = open_ >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_ ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins.append(b)
        places.append(capacity - room)
        left = room - size
        fills[b] = capacity - left
        if left:
            if not rooms[left]:
                open_ |= 1 << left
            rooms[left].append(b)
    return np.array(bins, np.int64), np.array(places, np.int64), np.array(fills, np.int64)


def packed(items: DataFrame, size_col: str, order: list[str], capacity: int, level: int) -> DataFrame:
    """Items with the bin they are in, their place there and its fill; each partition is packed by itself.

    The result depends only on the rows of a partition, so a task that runs again gives the same bins.
    """
    kinds = [f for f in items.schema.fields]
    names = [f.name for f in kinds]

    def run(batches) -> Iterator[pa.RecordBatch]:
        first = (level << 58) + (TaskContext.get().partitionId() << 34)
        held: list[pa.RecordBatch] = []
        count = 0

        def pack(table: pa.Table):
            nonlocal first
            table = table.sort_by([(size_col, "descending"), *((c, "ascending") for c in order)])
            bins, places, fills = best_fit(table.column(size_col).to_numpy(), capacity)
            table = table.append_column("bin", pa.array(bins + first))
            table = table.append_column("at", pa.array(places)).append_column("fill", pa.array(fills[bins]))
            first += len(fills)
            yield from table.to_batches(max_chunksize=65_536)

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, LOT - count)
                batch = batch.slice(part.num_rows)
                held.append(part)
                count += part.num_rows
                if count == LOT:
                    yield from pack(pa.Table.from_batches(held))
                    held, count = [], 0
        if count:
            yield from pack(pa.Table.from_batches(held))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds)
    return arrow_map(items.select(*names), run, f"{schema}, bin long, at long, fill long")


def pack(pieces: DataFrame, capacity: int, nearly: int = NEARLY, fan_in: int = FAN_IN, mix: int = MIX) -> DataFrame:
    """The pieces (id, piece, start, length, ...) with sequence_id and offset.

    Every piece of 1..capacity ids is in one sequence, sequences are gapless from 0 and at most capacity long. Repeated
    rows are pieces of their own. An empty table gives an empty result.
    """
    limit = capacity - nearly
    pieces = written(pieces, "pieces")
    # ranges of lengths would starve a partition of small pieces, so would files of like documents
    spread = pieces.repartition(max(1, -(-pieces.count() // mix)), F.xxhash64(*pieces.columns))
    base = written(packed(spread, "length", spread.columns, capacity, 0), "packed")
    under = base.where((F.col("at") == 0) & (F.col("fill") < limit)).select("bin", "fill")
    tasks = base.select(F.shiftright("bin", 34).alias("p")).distinct().count()
    levels: list[DataFrame] = []
    count = under.count()
    while tasks > 1 and count > 1 and len(levels) < 31:
        tasks = max(-(-tasks // fan_in), -(-count // LOT))
        items = under.select(F.col("bin").alias("child"), F.col("fill").alias("size"))
        level = written(
            packed(items.repartition(tasks, "child"), "size", ["child"], capacity, len(levels) + 1), "packed-level"
        )
        levels.append(level)
        under = level.where((F.col("at") == 0) & (F.col("fill") < limit)).select("bin", "fill")
        before, count = count, level.where(F.col("at") == 0).count()
        if count > 0.99 * before:
            break
        count = under.count()
    places = None  # of level bins in the last bins above them
    for level in reversed(levels):
        own = level.select("child", "bin", "at")
        if places is None:
            places = own.select("child", F.col("bin").alias("root"), F.col("at").alias("shift"))
        else:
            up = places.select(F.col("child").alias("bin"), "root", "shift")
            places = own.join(up, "bin", "left").select(
                "child", F.coalesce("root", "bin").alias("root"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("shift")
            )
    plain = base.withColumns({"sequence_id": F.col("bin"), "offset": F.col("at")})
    if places is not None:
        moved = base.where(F.col("fill") < limit).join(places.withColumnRenamed("child", "bin"), "bin")
        moved = moved.withColumns({"sequence_id": F.col("root"), "offset": F.col("at") + F.col("shift")})
        plain = plain.where(F.col("fill") >= limit).unionByName(moved.drop("root", "shift"))
    return plain.drop("bin", "at", "fill")


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every text.

    A null text is empty, so its one piece is the end id alone; a null id stays null, rows that repeat have pieces each, and an
    empty table gives an empty one."""
    pieces = token_pieces(docs, tokenizer_file, capacity, end_id, id_col, text_col)
    return pack(pieces, capacity).withColumnsRenamed({"id": "doc_id", "crc": "ids_crc32"})
