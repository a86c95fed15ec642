"""Byte-level BPE encoding and decoding by merge ranks, as Spark jobs over Arrow batches.

Every match of the split pattern is merged by itself: its pairs wait in one bucket per merge rank, a
hierarchical bitmap finds the lowest rank that waits, and entries that a merge has made stale are skipped when
they come up. A pre-token of n bytes costs O(n) bitmap steps however long it is. Pre-tokens met again come
from a bounded memo.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from shelfmark.llm.batches import arrow_map, id_and_text, record_batch, slices, texts

#: Entries of each memo of a worker; a full one starts anew after a block.
MEMO_ENTRIES = 600_000
#: Code points of a text worked on at a time.
BLOCK = 1 << 18


class RankQueue:
    """Positions in one bucket per rank. Three levels of 64-bit words mark the buckets that are not empty."""

    def __init__(self, ranks: int) -> None:
        self.leaf = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.leaf[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank that waits and its positions; None if nothing waits."""
        top = self.top
        if not top:
            return None
        b = (top & -top).bit_length() - 1
        word = self.mid[b]
        a = (b << 6) + (word & -word).bit_length() - 1
        word = self.leaf[a]
        low = word & -word
        rank = (a << 6) + low.bit_length() - 1
        self.leaf[a] = word = word ^ low
        if not word:
            self.mid[b] ^= 1 << (a & 63)
            if not self.mid[b]:
                self.top ^= 1 << b
        return rank, self.buckets.pop(rank)


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """The text in pieces of about size code points, cut only before a lone space inside of text.

    The split pattern always starts a match there, whatever stands before: a space followed by a
    non-space belongs to what follows, and a non-space before it ends its own match.
    """
    start, n = 0, len(text)
    while n - start > size:
        cut = text.find(" ", start + size)
        while cut != -1 and (cut + 1 == n or text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        yield text[start:cut]
        start = cut
    if start < n:
        yield text[start:]


#: Two adjacent characters of white space; without any, a text can be looked up word by word.
RUN = re.compile(r"\s\s")


def words_of(block: str) -> list[str] | None:
    """A block cut before every space and newline, spaces left out; None if white space comes in runs.

    A lone space starts the match that follows it and a lone newline is a match, so the first word is as it
    stands, one that starts with a newline too, and all others follow a space.
    """
    return None if RUN.search(block) else block.replace("\n", " \n").split(" ")


class Codec:
    """Encodes and decodes with the ranks of a file of base64 tokens and a split pattern."""

    def __init__(self, ranks_file: str, pattern: str) -> None:
        with open(ranks_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        top = max(self.ranks.values()) + 1
        self.vocabulary = [b""] * top
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token
        self.sizes = [len(t) for t in self.vocabulary]
        self.decimals = [str(i) for i in range(top)]
        # the patterns of this library mean the Unicode property, as Rust's do
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.queue = RankQueue(top)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pre-tokens: always the lowest rank first, the leftmost of equal ones.

        All of them wait in one queue; a gap of one byte keeps them apart.
        """
        ranks, sizes, queue = self.ranks, self.sizes, self.queue
        get, push = ranks.get, queue.push
        data = b"\0" + b"\0".join(pieces) + b"\0"
        after = list(range(1, len(data) + 1))  # start of the next part; 0 for a gap and for a part that is gone
        before = list(range(-1, len(data) - 1))
        end = 0
        after[0] = 0
        for piece in pieces:
            start, end = end + 1, end + 1 + len(piece)
            after[end] = 0
            for i in range(start, end - 1):
                rank = get(data[i : i + 2])
                if rank is not None:
                    push(rank, i)
        while (entry := queue.pop()) is not None:
            rank, waiting = entry
            size = sizes[rank]
            waiting.sort()
            for i in waiting:
                j = after[i]
                if not j or (k := after[j]) - i != size:
                    continue  # stale: a part was merged meanwhile
                after[i], after[j] = k, 0
                before[k] = i
                if last := after[k]:
                    new = get(data[i:last])
                    if new is not None:
                        push(new, i)
                if after[p := before[i]]:
                    new = get(data[p:k])
                    if new is not None:
                        push(new, p)
        out, end = [], 0
        for piece in pieces:
            i, end = end + 1, end + 1 + len(piece)
            ids = []
            while i < end:
                j = after[i]
                ids.append(ranks[data[i:j]])
                i = j
            out.append(tuple(ids))
        return out

    def learn_pieces(self, pieces: set[str]) -> None:
        """Puts pre-tokens into the memo. Those that are a token as a whole need no merging."""
        memo, whole, open_ = self.pieces, self.ranks.get, []
        new = [p for p in pieces if p not in memo]
        for p, raw in zip(new, [p.encode("utf-8", "surrogatepass") for p in new]):
            rank = whole(raw)
            if rank is None:
                open_.append((p, raw))
            else:
                memo[p] = (rank,)
        for at in range(0, len(open_), 4096):
            part = open_[at : at + 4096]
            for (p, _), ids in zip(part, self.merge([raw for _, raw in part])):
                memo[p] = ids

    def learn(self, words: set[str]) -> None:
        """Puts words into the memo, each with the space before it unless it starts with a newline."""
        memo = self.words
        found = [(w, self.find(w if w[:1] == "\n" else " " + w)) for w in words if w not in memo]
        self.learn_pieces({p for _, pieces in found for p in pieces})
        get = self.pieces.__getitem__
        for w, pieces in found:
            memo[w] = get(pieces[0]) if len(pieces) == 1 else tuple(chain.from_iterable(map(get, pieces)))

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, a block at a time."""
        for block in blocks(text):
            words = words_of(block)
            if words is None:
                pieces = self.find(block)
                self.learn_pieces(set(pieces))
                yield list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))
            else:
                first, *rest = words
                start = self.find(first)
                self.learn_pieces(set(start))
                ids = list(chain.from_iterable(map(self.pieces.__getitem__, start)))
                try:
                    ids.extend(list(chain.from_iterable(map(self.words.__getitem__, rest))))
                except KeyError:
                    self.learn(set(rest))
                    ids.extend(chain.from_iterable(map(self.words.__getitem__, rest)))
                yield ids
            if len(self.pieces) > MEMO_ENTRIES:
                self.pieces = {}
            if len(self.words) > MEMO_ENTRIES:
                self.words = {}

    def prepare(self, texts: list[str]) -> None:
        """Learns the words of many short texts in one go."""
        words: set[str] = set()
        for text in texts:
            if len(text) <= BLOCK and (found := words_of(text)) is not None:
                words.update(found[1:])
        self.learn(words)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(ranks_file: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(ranks_file, pattern)


ENCODED = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def encode(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every text. A null text has no ids; rows stay as they are, repeated or not."""

    def run(batches):
        c = codec(ranks_file, pattern)
        for b in slices(batches, 64):
            yield record_batch(ENCODED, b.column(0), [list(chain.from_iterable(c.encode(t))) for t in texts(b, 1)])

    return arrow_map(id_and_text(docs, id_col, text_col), run, "id long, ids array<int>")


def decode(encoded: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(id, bytes) of rows (id, ids); null ids give no bytes."""
    schema = pa.schema([("id", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        c = codec(ranks_file, pattern)
        for b in slices(batches, 64):
            yield record_batch(schema, b.column(0), [c.decode(ids or []) for ids in b.column(1).to_pylist()])

    return arrow_map(encoded.select("id", "ids"), run, "id long, bytes binary")


def round_trip(
    docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes decoded from them, in one pass.

    Ids leave a task only as digests, block by block, so a text of any length needs the memory of a block.
    A null text counts as empty; repeated rows give repeated results; a null id stays null.
    """

    def run(batches):
        c = codec(ranks_file, pattern)
        for b in slices(batches):
            counts, ids_hex, bytes_hex = [], [], []
            rows = texts(b, 1)
            c.prepare(rows)
            for text in rows:
                ids_hash, bytes_hash, n = hashlib.sha256(), hashlib.sha256(), 0
                for ids in c.encode(text):
                    if n and ids:
                        ids_hash.update(b" ")
                    ids_hash.update(" ".join(map(c.decimals.__getitem__, ids)).encode())
                    bytes_hash.update(c.decode(ids))
                    n += len(ids)
                counts.append(n)
                ids_hex.append(ids_hash.hexdigest())
                bytes_hex.append(bytes_hash.hexdigest())
            yield record_batch(DIGESTS, b.column(0), counts, ids_hex, bytes_hex)

    ids = id_and_text(docs, id_col, text_col)
    return arrow_map(ids, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
