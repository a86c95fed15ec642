"""Token counts of texts of any length by overlap resynchronisation.

A text longer than a chunk is encoded in overlapping chunks with offsets. Two neighbours are spliced at a place
in their overlap that is proven stable (white space on one side, which no token of this kind of tokenizer
spans and which no rule of its normaliser looks across) and that both encodings have as a token boundary with
equal tokens around it. Without such a place the overlap is widened, at last to the rest of the text.

Within a chunk, space-separated words met before are counted from a bounded memo.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmark.llm.batches import arrow_map, id_and_text, record_batch, slices, texts

#: Code points of a chunk and of the first overlap.
CHUNK, OVERLAP = 32_768, 512
#: Memo entries of a worker; a full memo starts anew.
MEMO_ENTRIES = 500_000
#: Unknown words encoded at a time.
ASKED = 4096



def words_of(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


Spans = list[tuple[int, int]]


def stable(text: str, at: int) -> bool:
    """Whether tokens of text[:at] and text[at:] are surely those of the text: white space stands beside."""
    return text[at - 1] in " \n\t" or text[at] in " \n\t"


def meeting(text: str, left: Spans, right: Spans, start: int, end: int) -> int | None:
    """The last stable place of the overlap start..end where both encodings break and agree up to it.

    The right chunk may start inside a word, so its tokens count only from the first stable place on.
    """
    first = next((p for p in range(start + 1, end) if stable(text, p)), None)
    if first is None:
        return None
    last = next((p for p in range(end - 1, first - 1, -1) if stable(text, p)), None)
    if last is None:
        return None
    a = [s for s in left if s[0] >= first and s[1] <= last]
    b = [s for s in right if s[0] >= first and s[1] <= last]
    crossed = any(s < p < e for p in (first, last) for spans in (left, right) for s, e in spans)
    return last if a == b and not crossed else None


def spliced_count(
    text: str, spans_of: Callable[[str], Spans], chunk: int = CHUNK, overlap: int = OVERLAP
) -> int:
    """Number of tokens of the text. spans_of gives the (start, end) of every token of a chunk."""
    n, start, total = len(text), 0, 0
    size = max(2, chunk)
    while n - start > size:
        end = start + size
        left = [(s + start, e + start) for s, e in spans_of(text[start:end])]
        width, place = max(2, min(overlap, size - 1)), None
        while True:
            right_start = end - width
            right = [(s + right_start, e + right_start) for s, e in spans_of(text[right_start : end + width])]
            place = meeting(text, left, right, right_start, end)
            if place is not None or width >= size - 1:
                break
            width = min(2 * width, size - 1)
        if place is None:  # nothing stable in the whole chunk: take a longer one
            size *= 2
            continue
        total += sum(1 for _, e in left if e <= place)
        start, size = place, max(2, chunk)
    return total + len(spans_of(text[start:]))


class Counter:
    """Counts tokens as the tokenizers library does, special strings in texts as by its default."""

    def __init__(self, file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[str, int] = {"": 0}

    def spans(self, chunk: str) -> Spans:
        return self.tokenizer.encode(chunk, add_special_tokens=False).offsets

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of each word, all encoded as one text with a space between them."""
        starts = [s for s, _ in self.spans(" ".join(words))]
        ends = np.cumsum([len(w) + 1 for w in words])
        return np.diff(np.searchsorted(starts, ends), prepend=0).tolist()

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.memo]
        for i in range(0, len(new), ASKED):
            self.memo.update(zip(new[i : i + ASKED], self.counts(new[i : i + ASKED])))

    def prepare(self, rows: list[str], chunk: int) -> None:
        """Learns the words of all texts of one chunk; a full memo starts anew before."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo = {"": 0}
        self.learn({w for t in rows if len(t) <= chunk for w in words_of(t)})

    def short(self, text: str) -> int:
        """A text of one chunk: the sum over its words, for no token or rule reaches across a space."""
        words = words_of(text)
        try:
            return sum(map(self.memo.__getitem__, words))
        except KeyError:
            self.learn(set(words))
            return sum(map(self.memo.__getitem__, words))

    def count(self, text: str, chunk: int, overlap: int) -> int:
        return self.short(text) if len(text) <= chunk else spliced_count(text, self.spans, chunk, overlap)


@lru_cache(maxsize=2)
def counter(file: str) -> Counter:
    return Counter(file)


COUNTS = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]
)


def token_counts(
    docs: DataFrame,
    tokenizer_file: str,
    limit: int = 2048,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and whether there are more than limit tokens, of every row.

    A null text counts as empty (no bytes, no tokens); repeated rows give repeated results. The tokenizer must
    not join tokens across white space, which holds for one that drops it.
    """

    def run(batches):
        c = counter(tokenizer_file)
        for b in slices(batches):
            rows = texts(b, 1)
            c.prepare(rows, chunk)
            found = [c.count(t, chunk, overlap) for t in rows]
            sizes = [len(t.encode("utf-8")) for t in rows]
            yield record_batch(COUNTS, b.column(0), sizes, found, [k > limit for k in found])

    counted = id_and_text(docs, id_col, text_col)
    return arrow_map(counted, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
