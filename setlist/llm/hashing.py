"""Words of many texts as arrays of 64-bit hashes, for tasks that run numpy.

A word is a run of bytes without white space, A-Z lower-cased. Its hash is a polynomial over
scrambled bytes, taken for all words at once from prefix sums modulo 2**64, then mixed.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that powers can be inverted
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of SplitMix64 on every number."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _power(n: int, base: int, name: str) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        size = 1 << max(16, n.bit_length())
        held = np.cumprod(np.r_[U64(1), np.full(size, base, dtype=U64)], dtype=U64)
        _powers[name] = held
    return held[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts in order, and the number of words of each text."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    blank = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[True, blank]))  # word starts and ends alternate; the data ends with a blank
    starts, ends = edge[0::2], edge[1::2]
    sums = np.cumsum(_BYTES[data] * _power(len(data), _BASE, "up"), dtype=U64)
    sums = np.r_[U64(0), sums]
    inverse = pow(_BASE, -1, 1 << 64)
    raw = (sums[ends] - sums[starts]) * _power(len(data) + 1, inverse, "down")[starts]
    hashes = mix(raw + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))
    limits = np.cumsum([len(t) + 1 for t in texts]) if texts else np.empty(0, dtype=np.int64)
    counts = np.diff(np.r_[0, np.searchsorted(starts, limits, side="left")])
    return hashes, counts


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, in order; with fewer words one hash of the whole, none without words."""
    if not len(words):
        return words
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, dtype=U64)
    for k in range(n):
        out = mix(out * U64(0x9FB21C651E98DF25) + words[k:len(words) - n + 1 + k])
    return out


def pieces(texts: list[bytes], at_most: int) -> list[tuple[int, int]]:
    """Ranges of texts of about `at_most` bytes together; a longer text is a piece of its own."""
    ranges, first, size = [], 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > at_most:
            ranges.append((first, i))
            first, size = i, 0
        size += len(text)
    if len(texts) > first:
        ranges.append((first, len(texts)))
    return ranges
