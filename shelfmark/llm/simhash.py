"""SimHash near-duplicates, their pairs found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each a (shortened) word of the Golay code.
Three or fewer differing bits leave at least two segments with at most one difference each. Segments that differ
in one bit decode to indices near each other: the index of one is among the indices of the other and of its
one-bit neighbours. So for every pair of segments a fingerprint gives keys (own index of one segment, nearby
indices of the other) and (the other way round); two fingerprints within three bits surely share a key, and others share
one the likelier the closer they are. Those that share a key are compared in full.

A node may have several fingerprints, from hashes that are mixed anew, which count together: 64 bits each, and keys of each.
So a threshold in wider reach than three bits is met with high probability; only three bits in any one are certain.

For near copies by similarity, fingerprints only find candidates: the shingle sets themselves decide, and a prefix filter
over shingles finds every similar pair (see `similar_sets`).

Equal fingerprints are one node. Within a key only links that join what was not joined yet are returned. A key
with many nodes is cut into blocks, and pairs of blocks are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import arrow_column, arrow_map, id_and_text, record_batch, slices
from shelfmark.llm.components import components
from shelfmark.llm.golay import decode, nearby
from shelfmark.operators.workspace import Scratch, written

#: Bits of the segments and the pairs of them that are keyed.
WIDTHS = (22, 21, 21)
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Differing bits of linked fingerprints at most; for one fingerprint, keys up to three are complete.
DISTANCE = 3
#: Nodes of a key compared in one go.
BLOCK = 2048
#: Shingles of whole texts counted together for the order of shingles, and how many common ones the order knows at most.
LOT, COMMON = 1 << 21, 1 << 16
#: Nodes that share a shingle and are compared in one go.
SHARERS = 512
#: Words of 64 parities in the coarse sketch of a set, and words of the filter of texts.
PARITIES, FILTER = 8, 1 << 17


def shingle_hashes(text: str, words: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of every run of so many words of the text with A-Z in lower case; of all words if there are fewer."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes split at exactly \x20, \x09-\x0D
    digest = xxhash.xxh64_intdigest
    if len(found) < words:
        return [digest(b" ".join(found), seed)] if found else []
    join = b" ".join
    return [digest(join(run), seed) for run in zip(*(found[i:] for i in range(words)))]


def remixed(hashes: np.ndarray, copy: int) -> np.ndarray:
    """The hashes themselves for the first fingerprint, and others made from them for further ones."""
    if not copy:
        return hashes
    x = hashes + np.uint64(copy * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: list[int], copy: int = 0) -> int:
    """The bits set in over half of the hashes."""
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = remixed(np.array(hashes[at : at + (1 << 16)], "<u8"), copy)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint_column(text_col: str, words: int = 3, copies: int = 1):
    """The fingerprints of a text as 8 bytes each, highest first; all zero for a null."""

    def run(column: pa.Array) -> pa.Array:
        out = []
        for t in column.to_pylist():
            hashes = shingle_hashes(t or "", words)
            out.append(b"".join(fingerprint(hashes, c).to_bytes(8, "big") for c in range(copies)))
        return pa.array(out, pa.binary())

    return arrow_column(run, "binary", F.col(f"`{text_col}`").cast("string"))


def segments(fps: np.ndarray) -> list[np.ndarray]:
    out, shift = [], 0
    for width in WIDTHS:
        out.append((fps >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.uint32))
        shift += width
    return out


def keys_of(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, which node) of all keys of nodes, a row of fingerprints each. A key names the fingerprint, the pair of
    segments and an index in each."""
    keys, rows = [], []
    for copy in range(nodes.shape[1]):
        parts = segments(nodes[:, copy])
        own = [decode(p).astype(np.int64) for p in parts]
        near = [nearby(p, w).astype(np.int64) for p, w in zip(parts, WIDTHS)]
        for k, (i, j) in enumerate(PAIRS):
            kind = copy * len(PAIRS) + k << 24
            # both ways round give the key of both own indices; the second leaves it out
            near_i = np.where(near[i] == own[i][:, None], -1, near[i])
            for a, b in ((own[i][:, None], near[j]), (near_i, own[j][:, None])):
                row, column = np.nonzero(np.broadcast_to((a >= 0) & (b >= 0), (len(nodes), max(a.shape[1], b.shape[1]))))
                grid = kind + (a << 12) + b
                keys.append(grid[row, column])
                rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def bits_apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.bitwise_count(left ^ right).sum(axis=-1, dtype=np.int64)


def close(left: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in left, in right) of the pairs within the distance."""
    found = []
    step = max(1, (1 << 20) // max(1, right.size))
    for at in range(0, len(left), step):
        a, b = np.nonzero(bits_apart(left[at : at + step, None, :], right[None, :, :]) <= distance)
        found.append((a + at, b))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def joining(left: np.ndarray, right: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks of nodes, or within one: the linked nodes."""
    other = left if right is None else right
    a, b = close(left, other, distance)
    if right is None:
        a, b = a[a < b], b[a < b]
    shift = 0 if right is None else len(left)
    parent = list(range(shift + len(other)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for n, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(i), root(j + shift)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(n)
    return left[a[kept]], other[b[kept]]


def as_nodes(column: pa.Array) -> np.ndarray:
    """Fingerprints of a binary column, one row for each value."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(len(raw), -1)


def as_bytes(nodes: np.ndarray) -> list[bytes]:
    raw, width = nodes.astype(">u8").tobytes(), 8 * nodes.shape[1]
    return [raw[at : at + width] for at in range(0, len(raw), width)]


LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("key", pa.int64()), ("block", pa.int32())])
LINKS_DDL = "a binary, b binary, key long, block int"


def links(nodes: DataFrame, partitions: int, distance: int = DISTANCE, block: int = BLOCK, write: Callable = written) -> DataFrame:
    """(a, b): links that join all nodes `fp`, distinct ones, that share a key and are within the distance of each other,
    directly or over others."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.binary())])

    def key_rows(batches):
        for b in slices(batches, 2048):
            values = b.column(0)
            keys, rows = keys_of(as_nodes(values))
            for at in range(0, len(keys), 1 << 16):
                yield record_batch(schema, keys[at : at + (1 << 16)], values.take(pa.array(rows[at : at + (1 << 16)])))

    keyed = arrow_map(nodes.select("fp"), key_rows, "key long, fp binary")
    dealt = keyed.repartition(partitions, "key").sortWithinPartitions("key", "fp")

    def result(pairs: list[tuple[np.ndarray, np.ndarray]], over: list[tuple[int, int, np.ndarray]]):
        a = [x for left, _ in pairs for x in as_bytes(left)]
        b = [x for _, right in pairs for x in as_bytes(right)]
        if a:
            yield record_batch(LINKS, a, b, [None] * len(a), [None] * len(a))
        for key, number, members in over:
            n = len(members)
            yield record_batch(LINKS, as_bytes(members), [None] * n, [key] * n, [number] * n)

    def compare(batches) -> Iterator[pa.RecordBatch]:
        """Nodes come sorted by key. A key of more than a block gives its blocks on, each compared in itself."""
        held_key, held, number = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, rows = batch.column(0).to_numpy(), as_nodes(batch.column(1))
            pairs, over = [], []
            if held is not None:
                keys = np.concatenate([np.full(len(held), held_key, np.int64), keys])
                rows = np.concatenate([held, rows])
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            sizes = np.diff(starts)
            full = starts[:-1][:-1]  # the last key may go on in the next batch
            two = full[sizes[:-1] == 2]
            near = two[bits_apart(rows[two], rows[two + 1]) <= distance]
            first_cut = number > 0  # the first key has given blocks on before
            if first_cut and len(near) and near[0] == 0:
                near = near[1:]
            pairs.append((rows[near], rows[near + 1]))
            for g in np.flatnonzero((sizes[:-1] > 2) | ((np.arange(len(sizes) - 1) == 0) & first_cut)):
                members, part = rows[starts[g] : starts[g + 1]], number if g == 0 else 0
                many = part > 0 or len(members) > block
                for at in range(0, len(members), block):
                    one = members[at : at + block]
                    pairs.append(joining(one, None, distance))
                    if many:
                        over.append((int(keys[starts[g]]), part, one))
                        part += 1
            last = starts[-2]
            if last > 0:
                number = 0
            held_key, held = int(keys[last]), rows[last:]
            while len(held) > block:
                one, held = held[:block], held[block:]
                pairs.append(joining(one, None, distance))
                over.append((held_key, number, one))
                number += 1
            yield from result(pairs, over)
        if held is not None and (len(held) > 1 or number):
            yield from result([joining(held, None, distance)], [(held_key, number, held)] if number else [])

    found = write(arrow_map(dealt, compare, LINKS_DDL), "key-links")
    direct = found.where("key is null").select("a", "b").distinct()
    over = found.where("key is not null").select("key", "block", F.col("a").alias("fp"))
    if over.isEmpty():
        return direct

    # pairs of blocks of one key, each in one group of rows
    blocks = over.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block"))
    seats = over.join(blocks, "key").withColumn("other", F.explode(others))
    seats = seats.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).alias("right"), "fp")
    seats = seats.repartition(4 * partitions, "key", "x", "y").sortWithinPartitions("key", "x", "y", "right", "fp")

    def compare_blocks(batches):
        at, sides = None, ([], [])

        def finish():
            if at is not None and sides[0] and sides[1]:
                left, right = (np.frombuffer(b"".join(s), ">u8").astype(np.uint64).reshape(len(s), -1) for s in sides)
                yield from result([joining(left, right, distance)], [])

        for batch in batches:
            for key, x, y, right, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, x, y) != at:
                    yield from finish()
                    at, sides = (key, x, y), ([], [])
                sides[right].append(fp)
        yield from finish()

    between = arrow_map(seats, compare_blocks, LINKS_DDL).select("a", "b")
    return direct.unionByName(between).distinct()


def labelled(docs: DataFrame, id_col: str, text_col: str, words: int, copies: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of every row, and (fp, component_id), the smallest id reachable from the rows of each fingerprint."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = id_and_text(docs, id_col, text_col).select("id", fingerprint_column("text", words, copies).alias("fp"))
    ids = written(ids, "fingerprints")
    nodes = written(ids.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    joined = components(links(nodes, partitions, distance))
    # nodes with links take the label of their component's least fingerprint, whose ids give the smallest id
    rooted = nodes.join(joined.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left")
    rooted = rooted.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    # written, so that the join back has exchanges of its own, which Spark can split for a large component
    smallest = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    return ids, rooted.join(smallest, "root").select("fp", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, copies: int = 1, distance: int = DISTANCE
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits for each copy) and component_id, the smallest id reachable over links.

    Rows with equal fingerprints are linked too, those of texts without a word (fingerprint zero) like any other. A null
    text has no word. A null id is nobody's component: one with only null ids has a null component_id.
    """
    ids, labels = labelled(docs, id_col, text_col, words, copies, distance)
    return ids.join(labels, "fp").select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def shingle_set(text: str, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def set_key(members: np.ndarray) -> bytes:
    """16 bytes that stand for a set of shingles; a set of none has none."""
    return xxhash.xxh128_digest(members.tobytes()) if len(members) else b""


def sketch(members: np.ndarray) -> bytes:
    """Whether the members in each part of the hash range are odd in number, for two parts a member or more, a power of two.
    Two sets differ in as many members at least as their sketches in bits."""
    words = PARITIES
    while 32 * words < len(members):
        words *= 2
    odd = np.bincount((members % np.uint64(64 * words)).astype(np.int64), minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(odd).tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """The sketch of the same set in so many bytes."""
    out = np.frombuffer(raw, np.uint8)
    while len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def may_be_similar(sizes, other_sizes, apart, similarity: float) -> np.ndarray:
    """Whether sets of such sizes, whose sketches differ in so many bits, can have the similarity. Never false if they have."""
    both = sizes + other_sizes
    fits = np.minimum(sizes, other_sizes) >= similarity * np.maximum(sizes, other_sizes) - 1e-6
    return fits & (apart <= both * (1 - similarity) / (1 + similarity) + 1e-6)


def prefix(members: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in an order for all sets, rare ones first. Two sets of the similarity share one of these."""
    keep = len(members) - int(np.ceil(similarity * len(members) - 1e-6)) + 1
    weight = np.zeros(len(members), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, members), len(common) - 1)
        weight = np.where(common[at] == members, counts[at], 0)
    return members[np.lexsort((members, weight))[:keep]]


SETS = pa.schema(
    [
        ("id", pa.int64()), ("content", pa.binary()), ("node", pa.binary()), ("fp", pa.binary()), ("size", pa.int64()), ("coarse", pa.binary()),
        ("sketch", pa.binary()), ("shingle", pa.int64()), ("times", pa.int64()),
    ]
)
SETS_DDL = "id long, content binary, node binary, fp binary, size long, coarse binary, sketch binary, shingle long, times long"


def content(text: str = "text"):
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def set_table(docs: DataFrame, words: int, copies: int, tmp: Scratch) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(id, content, node, fp, size, coarse, sketch) of every row, content standing for the text and node for its set; and
    the common shingles, sorted, with counts. Which ones are known as common tells how much work there is, not what is found."""

    def run(batches):
        lot, held = [], 0

        def counted():
            found, times = np.unique(np.concatenate(lot), return_counts=True)
            found, times = found[times > 2].view(np.int64), times[times > 2]
            return record_batch(SETS, *[[None] * len(found)] * 7, found, times)

        for b in slices(batches):
            rows = []
            for t in b.column(2).to_pylist():
                hashes = shingle_hashes(t or "", words)
                members = np.unique(np.array(hashes, np.uint64))
                fp = b"".join(fingerprint(hashes, c).to_bytes(8, "big") for c in range(copies))
                fine = sketch(members)
                rows.append((set_key(members), fp, len(members), folded(fine, 8 * PARITIES).tobytes(), fine))
                lot.append(members)
                held += len(members)
            none = [None] * len(rows)
            yield record_batch(SETS, b.column(0), b.column(1), *(list(c) for c in zip(*rows)), none, none)
            if held >= LOT:
                yield counted()
                lot, held = [], 0
        if lot:
            yield counted()

    table = tmp.written(arrow_map(docs.select("id", content().alias("content"), "text"), run, SETS_DDL), "shingle-sets")
    common = table.where("node is null").groupBy("shingle").agg(F.sum("times").alias("times"))
    rows = common.orderBy(F.desc("times"), "shingle").limit(COMMON).toArrow()
    shingles, times = (rows.column(c).to_numpy() for c in ("shingle", "times"))
    shingles = shingles.astype(np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return table.where("node is not null").drop("shingle", "times"), shingles[order], times[order].astype(np.int64)


SHARED = pa.schema([("shingle", pa.int64()), ("node", pa.binary()), ("size", pa.int32()), ("place", pa.int32()), ("block", pa.int32())])
SHARED_DDL = "shingle long, node binary, size int, place int"


def sharers(docs: DataFrame, words: int, similarity: float, common: np.ndarray, counts: np.ndarray, partitions: int, tmp: Scratch) -> DataFrame:
    """(shingle, node, size, place, block) of all nodes that have a shingle of their prefix, at such a place, in common with
    another node; the nodes of a shingle are numbered blocks of SHARERS by size. Every pair of the similarity is among the nodes
    of some shingle."""

    def rows(batches):
        for b in slices(batches):
            keys, firsts, sizes = [], [], []
            for t in b.column(0).to_pylist():
                members = shingle_set(t or "", words)
                if len(members):
                    firsts.append(prefix(members, common, counts, similarity))
                    keys.append(set_key(members))
                    sizes.append(len(members))
            if keys:
                lengths = [len(f) for f in firsts]
                at = np.repeat(np.arange(len(keys)), lengths)
                places = np.concatenate([np.arange(n) for n in lengths])
                schema = pa.schema(list(SHARED)[:4])
                yield record_batch(schema, np.concatenate(firsts).view(np.int64), pa.array(keys, pa.binary()).take(pa.array(at)), np.array(sizes)[at], places)

    def numbered(batches):
        """Rows come sorted by shingle, size and node; a row is held until the next tells whether it has company."""
        last, seen = None, 0
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row == last:
                    continue
                if last is not None and row[0] == last[0]:
                    if seen == 0:
                        out.append((*last, 0))
                    seen += 1
                    out.append((*row, seen // SHARERS))
                else:
                    seen = 0
                last = row
            if out:
                yield record_batch(SHARED, *(list(c) for c in zip(*out)))

    dealt = arrow_map(docs.select("text"), rows, SHARED_DDL).repartition(partitions, "shingle")
    return tmp.written(arrow_map(dealt.sortWithinPartitions("shingle", "size", "node"), numbered, f"{SHARED_DDL}, block int"), "sharers")


def texts_of(docs: DataFrame, contents: DataFrame) -> DataFrame:
    """(content, text), once for each of the contents. A filter of bounded size over them tells which texts are read; what it
    lets through in vain is dropped by the join."""
    bits = contents.select(F.pmod(F.xxhash64("content"), F.lit(64 * FILTER)).alias("at"))
    bits = bits.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, int(at & 63L))").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    mask = np.zeros(FILTER, np.uint64)
    mask[found.column("word").to_numpy().astype(np.int64)] = found.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    schema = pa.schema([("content", pa.binary()), ("text", pa.string())])

    def run(batches):
        for b in slices(batches):
            at = b.column(0).to_numpy() % (64 * FILTER)
            chosen = (mask[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            yield record_batch(schema, *(c.cast(f.type) for c, f in zip(b.select([1, 2]).filter(pa.array(chosen)).columns, schema)))

    keyed = docs.select(content().alias("content"), "text").select(F.xxhash64("content").alias("key"), "content", "text")
    read = arrow_map(keyed, run, "content binary, text string")
    return read.join(contents, "content", "left_semi").groupBy("content").agg(F.first("text").alias("text"))


ENDS = pa.schema([("a", pa.binary()), ("b", pa.binary())])
ENDS_DDL = "a binary, b binary"


OF_ENDS = ("node", "content", "size", "sketch")


def end(sets: DataFrame, x: str, fp: str | None = None) -> DataFrame:
    """What is told of one end of a pair: the node as `a` or `b`, the rest with that suffix; and the fingerprint under a name."""
    named = [F.col("fp").alias(fp)] if fp else []
    return sets.select(*named, *(F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in OF_ENDS))


def verified(pairs: DataFrame, docs: DataFrame, words: int, similarity: float, tmp: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have the Jaccard similarity, of pairs with both `end`s. Sketches spare nearly all
    pairs well below it the comparison of their texts."""

    def by_sketch(batches):
        for b in batches:
            size, other, left, right = (b.column(c).to_pylist() for c in range(4))
            apart = [int(np.bitwise_count(folded(x, n := min(len(x), len(y))) ^ folded(y, n)).sum(dtype=np.int64)) for x, y in zip(left, right)]
            fits = may_be_similar(np.array(size, np.int64), np.array(other, np.int64), np.array(apart, np.int64), similarity)
            yield b.select([4, 5, 6, 7]).filter(pa.array(fits.astype(bool)))

    def by_text(batches):
        for batch in batches:
            for b in (batch.slice(at, 64) for at in range(0, batch.num_rows, 64)):
                known: dict[bytes, np.ndarray] = {}
                fits = []
                for left, right, *texts in zip(*(c.to_pylist() for c in b.columns)):
                    for node, text in zip((left, right), texts):
                        if node not in known:
                            known[node] = shingle_set(text or "", words)
                    same = len(np.intersect1d(known[left], known[right], assume_unique=True))
                    fits.append(same / (len(known[left]) + len(known[right]) - same) >= similarity)
                yield b.select([0, 1]).filter(pa.array(fits, pa.bool_())).cast(ENDS)

    pairs = pairs.select("size_a", "size_b", "sketch_a", "sketch_b", "a", "b", "content_a", "content_b")
    pairs = tmp.written(arrow_map(pairs, by_sketch, "a binary, b binary, content_a binary, content_b binary"), "candidates")
    contents = pairs.select(F.explode(F.array("content_a", "content_b")).alias("content")).distinct()
    texts = texts_of(docs, contents)
    for x in "ab":
        pairs = pairs.join(texts.select(F.col("content").alias(f"content_{x}"), F.col("text").alias(f"text_{x}")), f"content_{x}")
    return tmp.written(arrow_map(pairs.select("a", "b", "text_a", "text_b"), by_text, ENDS_DDL), "verified")


def across(shared: DataFrame, sets: DataFrame, labels: DataFrame, similarity: float, partitions: int, tmp: Scratch) -> DataFrame:
    """(a, b): all pairs of nodes of different labels that share a shingle of their prefixes and whose sizes, places of the
    shingle and coarse sketches allow the similarity. labels: (a, b) as components returns them.

    Blocks of a shingle whose sizes are too far apart, or which have one label, never meet."""
    known = labels.select(F.col("a").alias("node"), F.col("b").alias("root"))
    known = tmp.written(sets.select("node", "coarse").join(known, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"), "labels")
    # shingles of one label have nothing more to tell
    open_ = shared.select("shingle", "node").join(known.select("node", "label"), "node").groupBy("shingle")
    open_ = open_.agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("shingle")
    rows = tmp.written(shared.join(open_, "shingle", "left_semi").join(known, "node"), "open")
    blocks = rows.groupBy("shingle", "block").agg(
        F.min("size").alias("least"), F.max("size").alias("most"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    blocks = tmp.written(blocks, "blocks")
    left, right = (blocks.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in blocks.columns[1:])) for x in "xy")
    apart = (F.col("low_x") != F.col("high_x")) | (F.col("low_y") != F.col("high_y")) | (F.col("low_x") != F.col("low_y"))
    meet = left.join(right, "shingle").where((F.col("block_x") <= F.col("block_y")) & (F.col("least_y") * similarity <= F.col("most_x") + 1e-6) & apart)
    meet = tmp.written(meet.select("shingle", F.col("block_x").alias("x"), F.col("block_y").alias("y")), "meetings")
    seat = lambda side: rows.join(meet.withColumn("block", F.col(side)), ["shingle", "block"])
    seats = seat("x").withColumn("right", F.lit(False)).unionByName(seat("y").where("x <> y").withColumn("right", F.lit(True)))
    seats = seats.select("shingle", "x", "y", "right", "node", "label", "size", "place", "coarse")
    seats = seats.repartition(partitions, "shingle", "x", "y").sortWithinPartitions("shingle", "x", "y", "right", "node")

    def compare(batches):
        at, sides = None, ([], [])

        def finish():
            within = at is None or at[1] == at[2]
            left, right = sides[0], sides[0] if within else sides[1]
            if not left or not right:
                return
            (nodes, labels_, sizes, places, sketches), (nodes2, labels2, sizes2, places2, sketches2) = (
                (n, np.array(la, object), np.array(si), np.array(pl), np.frombuffer(b"".join(sk), ">u8").astype(np.uint64).reshape(len(n), -1))
                for n, la, si, pl, sk in (tuple(zip(*s)) for s in (left, right))
            )
            # where two sets of the similarity first meet, enough members are left in both
            rest = np.minimum((sizes - places)[:, None], (sizes2 - places2)[None, :])
            enough = rest >= similarity / (1 + similarity) * (sizes[:, None] + sizes2[None, :]) - 1e-6
            a, b = np.nonzero(enough & (labels_[:, None] != labels2[None, :]))
            if within:
                a, b = a[a < b], b[a < b]
            fits = may_be_similar(sizes[a], sizes2[b], bits_apart(sketches[a], sketches2[b]), similarity)
            if fits.any():
                ends = [(min(nodes[i], nodes2[j]), max(nodes[i], nodes2[j])) for i, j in zip(a[fits].tolist(), b[fits].tolist())]
                yield record_batch(ENDS, *(list(c) for c in zip(*ends)))

        for batch in batches:
            for shingle, x, y, right, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (shingle, x, y) != at:
                    yield from finish()
                    at, sides = (shingle, x, y), ([], [])
                sides[right].append(row)
        yield from finish()

    out = tmp.written(arrow_map(seats, compare, ENDS_DDL).distinct(), "across")
    tmp.drop(known, rows, blocks, meet)
    return out


def similar_sets(docs: DataFrame, words: int, copies: int, similarity: float, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, node) of every row (id, text), node empty without a word, and (a, b) as components returns them of nodes linked by
    a Jaccard similarity of their shingle sets, as tables of `tmp`. A null text is empty; an empty table gives empty ones.

    Two sets of the similarity share one of their first shingles in a fixed order, so only nodes that do so take part. Close
    fingerprints link most of them, in one link for each node even in a large group; then pairs that share a first shingle but
    are not joined yet are all looked at. Every link is verified on the texts."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table, common, counts = set_table(docs, words, copies, tmp)
    shared = sharers(docs, words, similarity, common, counts, partitions, tmp)
    one = table.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node")
    sets = tmp.written(one.agg(F.min("content").alias("content"), *(F.first(c).alias(c) for c in ("fp", "size", "coarse", "sketch"))), "sets")
    distance = int(round((1 - similarity) * 64 * copies, 6))
    # of the nodes with one fingerprint the least stands for all; what verifies its links comes with it
    least = F.min(F.struct(*OF_ENDS)).alias("end")
    of_fp = tmp.written(sets.groupBy("fp").agg(least).select("fp", "end.*"), "nodes")
    found = links(of_fp, partitions, distance, write=tmp.written).withColumnsRenamed({"a": "left", "b": "right"})
    found = found.join(end(of_fp, "a", "left"), "left").join(end(of_fp, "b", "right"), "right").drop("left", "right")
    equal = end(of_fp, "a", "fp").join(end(sets, "b", "fp"), "fp").where("a <> b").drop("fp")
    first = verified(found.unionByName(equal), docs, words, similarity, tmp)
    pairs = across(shared, sets, components(first, tmp.written), similarity, partitions, tmp)
    tmp.drop(shared)
    rest = verified(pairs.join(end(sets, "a"), "a").join(end(sets, "b"), "b"), docs, words, similarity, tmp)
    return table.select("id", "node"), components(first.unionByName(rest), tmp.written)


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, copies: int = 4, similarity: float = 0.8
) -> DataFrame:
    """All columns of one row of each group, the one with the smallest id; groups are linked where the Jaccard similarity of
    the sets of shingles is at least such. Of rows that repeat this id the one with the least text stays.

    Texts without a word tell nothing about each other, so they stay."""
    narrow = id_and_text(docs, id_col, text_col)
    with Scratch(docs.sparkSession) as tmp:
        ids, joined = similar_sets(narrow, words, copies, similarity, tmp)
        joined = joined.select(F.col("a").alias("node"), F.col("b").alias("root"))
        rooted = tmp.written(ids.join(joined, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root")), "rooted")
        smallest = rooted.where("node <> x''").groupBy("root").agg(F.min("id").alias("id"))
        kept = rooted.where("node = x''").select("id").unionByName(smallest.select("id")).distinct()
        kept = written(kept.withColumnRenamed("id", "_kept"), "kept-ids")
    rows = docs.join(kept, docs[f"`{id_col}`"].eqNullSafe(kept["_kept"]), "left_semi")
    repeated = narrow.groupBy("id").count().where("count > 1").select(F.col("id").alias("_again"))
    if repeated.isEmpty():
        return rows
    again = rows[f"`{id_col}`"].eqNullSafe(repeated["_again"])
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    least = F.min_by(row, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    one = rows.join(repeated, again, "left_semi").groupBy(F.col(f"`{id_col}`").alias("_id")).agg(least.alias("row"))
    return rows.join(repeated, again, "left_anti").unionByName(one.select("row.*"))
