"""Exact and near copies against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from shelfmark.llm import components, exact_dedup, golay, order_minhash, simhash

SCHEMA = "doc_id long, text string, fp string, top long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)


ROWS = [
    (1, "Same TEXT"), (2, "same text"), (3, "same text "), (4, None), (5, ""), (6, "Ä"), (7, "ä"), (8, "long " * 5000),
    (9, "LONG " * 5000), (9, "long " * 5000), (10, "own"), (None, "own"), (None, "nobody"), (12, "twice"), (12, "twice"),
]


def brute_force(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")].append(i)
    out = []
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        out += [(i, top, len(ids), i == top, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("settings", [{}, {"table_bytes": 300, "hash_of": lambda c: len(c) % 2}])
def test_exact_duplicates(spark, settings):
    """The second settings give hashes that tell little and tables that hold one content: only content decides."""
    rows = exact_dedup.exact_duplicates(frame(spark, ROWS), **settings).collect()
    assert sorted((tuple(r) for r in rows), key=str) == brute_force(ROWS)


def test_drop_exact_duplicates(spark):
    out = exact_dedup.drop_exact_duplicates(frame(spark, ROWS))
    assert out.columns == ["doc_id", "text", "fp", "top"]
    kept = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    want = [(2, "same text"), (3, "same text "), (5, ""), (6, "Ä"), (7, "ä"), (9, "long " * 5000), (10, "own"), (None, "nobody"), (12, "twice")]
    assert kept == sorted(want, key=str)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.drop_exact_duplicates(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(none).count() == 0
    assert order_minhash.compare_with_next(none).count() == 0


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.uint32)
    assert (np.bincount(golay.decode(words)) == 2048).all()


def test_three_bits_share_a_key():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, (400, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = a.copy()
    for _ in range(3):
        b[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)
    held = []
    for nodes in (a, b):
        keys, rows = simhash.keys_of(nodes)
        sets = [set() for _ in nodes]
        for k, r in zip(keys.tolist(), rows.tolist()):
            assert k not in sets[r]
            sets[r].add(k)
        held.append(sets)
    assert all(x & y for x, y in zip(*held))


def near_rows():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, None), (3, ""), (5, " \n"), (6, "one"), (7, "ONE"), (8, "two words"), (9, "a b c"), (10, "a b c a b c")]
    for base in range(12):
        text = rng.choice(words, 400).tolist()
        for copy in range(12):
            changed = list(text)
            for _ in range(copy // 3):
                changed[rng.integers(0, 400)] = "edited"
            rows.append((100 + base * 50 + copy, " ".join(changed)))
    return rows


def linked(ids, fps, distance):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for n, i in enumerate(ids):
        least[root(n)] = min(least.get(root(n), i), i)
    return {i: least[root(n)] for n, i in enumerate(ids)}


def test_near_duplicates(spark):
    rows = near_rows()
    fps = [simhash.fingerprint(simhash.shingle_hashes(t or "")) for _, t in rows]
    want = linked([i for i, _ in rows], fps, 3)
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == dict(zip([i for i, _ in rows], fps))
    assert len(set(want.values())) < len(rows) - 20


def test_fingerprint_by_definition(spark):
    """Spark's own XXH64 has the same seed."""
    text = "Some Words here, and\tsome  more words HERE"
    words = [w.lower() for w in text.split()]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [r[0] % (1 << 64) for r in spark.createDataFrame([(s,) for s in shingles], "s string").selectExpr("xxhash64(s)").collect()]
    assert simhash.shingle_hashes(text) == hashes
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(hashes) == bits


def test_blocks_of_a_hot_key(spark):
    """Keys cut into blocks of two nodes join the same nodes."""
    rng = np.random.default_rng(9)
    base = int(rng.integers(0, 1 << 62))
    nodes = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))})
    df = spark.createDataFrame([(x.to_bytes(8, "big"),) for x in nodes], "fp binary")

    def roots(block):
        pairs = [(int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")) for r in simhash.links(df, 4, 3, block).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
        parent = {x: x for x in nodes}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        return [root(x) for x in nodes]

    want = linked(nodes, nodes, 3)
    assert roots(2048) == roots(2) == [want[x] for x in nodes]


def test_drop_near_duplicates(spark):
    rng = np.random.default_rng(6)
    words = [f"v{i}" for i in range(500)]
    bases = [rng.choice(words, 300).tolist() for _ in range(6)]
    rows = [(n, " ".join(b)) for n, b in enumerate(bases)]
    rows += [(100 + n, " ".join([*b[:150], "changed", *b[151:]])) for n, b in enumerate(bases)]  # similarity 0.97
    rows += [(200, None), (201, ""), (0, rows[0][1]), (None, "alone " * 9)]
    out = simhash.drop_near_duplicates(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "fp", "top"]
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([*range(6), 200, 201, None], key=str)


def jaccard_groups(rows, similarity=0.8):
    """The smallest id of each group linked by the similarity of five-word shingles, pair by pair."""
    sets = [set(simhash.shingle_hashes(t, 5)) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same / (len(sets[i]) + len(sets[j]) - same) >= similarity:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[root(n)] = min(least.get(root(n), i), i)
    return set(least.values())


def test_distinct_texts_stay(spark):
    """Close fingerprints alone link nothing: short texts that differ in the last word, a templated family, pairs from 0.6 on."""
    rng = np.random.default_rng(12)
    words = [f"u{i}" for i in range(2000)]
    rows = []
    for n in range(20):
        base = rng.choice(words, 7).tolist()
        rows += [(10 * n + k, " ".join([*base, f"last{k}"])) for k in range(3)]  # 3 of 5 shingles are shared
    family = rng.choice(words, 40).tolist()
    rows += [(1000 + k, " ".join([*family[:20], f"x{k}", *family[21:]])) for k in range(30)]
    for n in range(60):
        base = rng.choice(words, 204).tolist()
        tail = rng.choice(words, 12 + n % 36).tolist()  # similarity 0.62 to 0.9
        rows += [(2000 + 2 * n, " ".join(base)), (2001 + 2 * n, " ".join(base[: 204 - len(tail)] + tail))]
    want = jaccard_groups(rows)
    assert {i for i, _ in rows if i < 2000} <= want
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()} == want


@pytest.mark.parametrize("sharers", [512, 4])
def test_all_near_copies_are_found(spark, sharers, monkeypatch):
    """In every band of similarity, also where fingerprints share no key; small blocks of a shingle's nodes give the same."""
    monkeypatch.setattr(simhash, "SHARERS", sharers)
    rng = np.random.default_rng(13)
    words = [f"t{i}" for i in range(3000)]
    rows, bands = [], {}
    for n in range(240):
        base = rng.choice(words, 154).tolist()
        changed = list(base)
        for at in rng.choice(30, 1 + n % 4, replace=False):
            changed[5 * at + 2] = f"new{at}"
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(changed))]
        a, b = (set(simhash.shingle_hashes(t, 5)) for _, t in rows[-2:])
        bands.setdefault(int(20 * len(a & b) / len(a | b) + 1e-9) / 20, []).append(2 * n + 1)
    hot = rng.choice(words, 100).tolist()
    rows += [(5000 + k, " ".join([*hot[:k], f"one{k}", *hot[k + 1 :]])) for k in range(60)]
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()}
    found = {band: sum(i not in kept for i in ids) / len(ids) for band, ids in sorted(bands.items())}
    assert len(found) > 2 and all(share == (1.0 if band >= 0.8 else 0.0) for band, share in found.items())
    assert kept == jaccard_groups(rows)


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(300, 301), (301, 300), (5, 5)] + [(1000, x) for x in range(1001, 1100)]
    got = {(r["a"], r["b"]) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 201)} | {(301, 300)} | {(x, 1000) for x in range(1001, 1100)}


def test_order_minhash(spark):
    rows = [(5, "b" * 40), (1, None), (3, "abcdefgh" * 30), (2, "xy"), (9, "abcdefgh" * 30), (9, "abcdefgh" * 30), (7, "The quick brown fox. " * 9)]
    ordered = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    got = sorted(order_minhash.compare_with_next(frame(spark, rows)).collect(), key=lambda r: (r["doc_id"], r["n_chars"]))
    assert len(got) == len(rows)
    for n, r in enumerate(got):
        text, following = ordered[n][1] or "", ordered[(n + 1) % len(rows)][1] or ""
        new = order_minhash.edited(text, following)
        k = len(text) // 4
        assert new == text[: len(text) - k] + following[:k]
        own, next_, changed = (order_minhash.fingerprint(t) for t in (text, following, new))
        assert r["doc_id"] == ordered[n][0] and r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == order_minhash.text_of(own) and r["edited_fingerprint"] == order_minhash.text_of(changed)
        assert r["near_edited"] == order_minhash.likeness(own, changed) and r["near_next"] == order_minhash.likeness(own, next_)


def plain_fingerprint(text, k=8, components=32, chosen=2):
    """The definition in Python integers: number equal k-mers by occurrence, take the least two by each hash function, put them back
    into text order, hash that pair."""
    whole, base = 1 << 64, 0x9E3779B97F4A7C15

    def mix(x):
        x = (x ^ x >> 31) * 0x7FB5D329728EA185 % whole
        x = (x ^ x >> 27) * 0x81DADEF4BC2DD44D % whole
        return x ^ x >> 33

    if not text:
        return [0] * components
    points = [mix(ord(c) + 1) for c in text]
    seen, marks = {}, []
    for at in range(max(1, len(points) - k + 1)):
        total = len(points) if len(points) < k else 0  # a text shorter than a k-mer is one, with its length
        for x in points[at : at + k]:
            total = (total * base + x) % whole
        kmer = text[at : at + k]
        times = seen[kmer] = seen.get(kmer, -1) + 1
        total = mix(total)
        marks.append((mix((total + times * base) % whole) if times else total) >> 32)
    out = []
    for c in range(1, components + 1):
        factor = mix(c) >> 32 | 1
        least = sorted(range(len(marks)), key=lambda i: (marks[i] * factor % (1 << 32), i))[:chosen]
        sign = 1
        for i in sorted(least):
            sign = mix((sign * base + marks[i]) % whole)
        out.append(sign >> 48)
    return out


def test_order_minhash_by_definition(spark):
    """Fingerprints, edited texts and likenesses of the query from the plain definition, none of them by the module's own functions."""
    rng = np.random.default_rng(21)
    letters = [*"abc d", "é", "日", "\U0001f600"]
    texts = ["", None, "a", "abcdefg", "abcdefgh", "ab" * 60, "x" * 500, *("".join(rng.choice(letters, rng.integers(1, 300))) for _ in range(20))]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    ordered = sorted(rows)
    got = sorted(order_minhash.compare_with_next(frame(spark, rows)).collect(), key=lambda r: r["doc_id"])
    for n, (r, (i, t)) in enumerate(zip(got, ordered)):
        text, following = t or "", ordered[(n + 1) % len(ordered)][1] or ""
        cut = len(text) // 4
        new = text[: len(text) - cut] + following[:cut]
        own, changed, next_ = (plain_fingerprint(x) for x in (text, new, following))
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r["fingerprint"] == "".join(f"{x:04x}" for x in own) and r["edited_fingerprint"] == "".join(f"{x:04x}" for x in changed)
        like = lambda x, y: sum(p == q for p, q in zip(x, y)) / 32
        assert (r["near_edited"], r["near_next"]) == (like(own, changed), like(own, next_))


def test_order_matters():
    words = [f"word{i} " for i in range(200)]
    text, turned = "".join(words), "".join(words[100:] + words[:100])
    shuffled = "".join(reversed(words))
    print_ = order_minhash.fingerprint
    same, half, none = (order_minhash.likeness(print_(text), print_(t)) for t in (text, turned, shuffled))
    assert same == 1 and none < half < 1


def test_occurrences_are_numbered():
    h = np.array([7, 9, 7, 7, 9], np.uint64) << np.uint64(40)
    out = order_minhash.numbered(h)
    assert len(set(out.tolist())) == 5 and out[0] == order_minhash.numbered(h[:1])[0]
