"""The perfect binary Golay code (23, 12): every 23-bit word lies within 3 bits of exactly one codeword."""

from __future__ import annotations

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator of the code.
GENERATOR = 0b101011100011


def _remainders() -> np.ndarray:
    """The remainder of every power x^0..x^22 by the generator."""
    out = []
    for power in range(23):
        r = 1 << power
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= GENERATOR << (bit - 11)
        out.append(r)
    return np.array(out, np.uint32)


_POWERS = _remainders()


def _tables() -> list[np.ndarray]:
    """Syndromes of every value of each byte of a word."""
    values = np.arange(256)
    tables = []
    for low in (0, 8, 16):
        t = np.zeros(256, np.uint32)
        for bit in range(min(8, 23 - low)):
            t ^= np.where(values >> bit & 1, _POWERS[low + bit], 0).astype(np.uint32)
        tables.append(t)
    return tables


_BYTES = _tables()


def syndrome(words: np.ndarray) -> np.ndarray:
    return _BYTES[0][words & 255] ^ _BYTES[1][words >> 8 & 255] ^ _BYTES[2][words >> 16]


def _errors() -> np.ndarray:
    """The error pattern of at most 3 bits for each of the 2048 syndromes."""
    one = np.uint32(1) << np.arange(23, dtype=np.uint32)
    two = np.array([one[i] | one[j] for i in range(23) for j in range(i)], np.uint32)
    three = np.array([one[i] | one[j] | one[k] for i in range(23) for j in range(i) for k in range(j)], np.uint32)
    patterns = np.concatenate([np.zeros(1, np.uint32), one, two, three])
    table = np.zeros(2048, np.uint32)
    table[syndrome(patterns)] = patterns
    return table


_ERRORS = _errors()


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    words = words.astype(np.uint32)
    return (words ^ _ERRORS[syndrome(words)]) >> np.uint32(11)


def nearby(words: np.ndarray, width: int) -> np.ndarray:
    """For each word the indices of the codewords nearest to it and to every word one of its low width bits
    away: one row of width + 1 indices each, in which an index that came before is -1."""
    words = words.astype(np.uint32)
    flips = np.concatenate([np.zeros(1, np.uint32), np.uint32(1) << np.arange(width, dtype=np.uint32)])
    found = np.sort(decode(words[:, None] ^ flips[None, :]).astype(np.int32), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found
