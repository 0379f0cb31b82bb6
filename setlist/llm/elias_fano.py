"""Elias-Fano sequences and the n-gram trie built from them, in one memory-mapped file."""

from __future__ import annotations

import tempfile

import numpy as np

U64 = np.uint64


class MappedFile:
    """Arrays appended to a temporary file and read back memory-mapped; the file goes with the object."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()

    def hold(self, array: np.ndarray) -> np.ndarray:
        if not array.nbytes:
            return array
        at = self.file.seek(0, 2)
        at += self.file.write(b"\0" * (-at % 8))
        at -= at % 8
        self.file.write(np.ascontiguousarray(array).tobytes())
        self.file.flush()
        return np.memmap(self.file, dtype=array.dtype, mode="r", offset=at, shape=array.shape)


class EliasFano:
    """A non-decreasing sequence of integers below 2**62: low bits packed, high bits in unary.

    `at` reads elements, `find` searches them; both take arrays.
    """

    def __init__(self, values: np.ndarray, limit: int, file: MappedFile):
        self.n = len(values)
        self.low_bits = max(0, min(56, (limit // max(1, self.n)).bit_length() - 1))
        low, high = values & U64((1 << self.low_bits) - 1), (values >> U64(self.low_bits)).astype(np.int64)
        packed = np.zeros((self.n * self.low_bits + 7) // 8 + 8, dtype=np.uint8)
        for first in range(0, self.n, 1 << 16):  # 65,536 elements fill whole bytes
            part = low[first:first + (1 << 16)]
            bits = (part[:, None] >> np.arange(self.low_bits, dtype=U64)) & U64(1)
            done = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
            at = first * self.low_bits // 8
            packed[at:at + len(done)] = done
        self.low = file.hold(packed)
        # Eight bytes from every byte on, so that an element is one read and a shift.
        self.low_words = np.ndarray((len(packed) - 7,), dtype="<u8", buffer=self.low, strides=(1,))
        unary = np.zeros((int(high[-1]) if self.n else 0) + self.n + 1, dtype=np.uint8)
        unary[high + np.arange(self.n)] = 1
        self.high = file.hold(np.packbits(unary, bitorder="little"))
        self.high_size = len(unary)
        self._starts: np.ndarray | None = None

    def starts(self) -> np.ndarray:
        """First element of every high part, read off the unary bits (the zeros end the parts); made once."""
        if self._starts is None:
            bits = np.unpackbits(self.high, count=self.high_size, bitorder="little")
            zeros = np.flatnonzero(bits == 0)
            self._starts = np.r_[0, zeros - np.arange(len(zeros))]
        return self._starts

    def _low(self, index: np.ndarray) -> np.ndarray:
        bit = index * self.low_bits
        return (self.low_words[bit >> 3] >> (bit & 7).astype(U64)) & U64((1 << self.low_bits) - 1)

    def at(self, index: np.ndarray) -> np.ndarray:
        high = np.searchsorted(self.starts(), index, side="right") - 1
        return (high.astype(U64) << U64(self.low_bits)) | self._low(index)

    def find(self, x: np.ndarray, lo: np.ndarray | int, hi: np.ndarray | int) -> np.ndarray:
        """Per query its place within [lo, hi), or -1: successor search in the elements of its high part."""
        starts = self.starts()
        high, low = (x >> U64(self.low_bits)).astype(np.int64), x & U64((1 << self.low_bits) - 1)
        last = len(starts) - 2
        known = np.minimum(high, last)
        left, right = np.clip(starts[known], lo, hi), np.clip(starts[known + 1], lo, hi)
        right = np.where(high > last, left, right)
        end = right.copy()
        open_ = np.flatnonzero(left < right)
        while len(open_):
            mid = (left[open_] + right[open_]) >> 1
            less = self._low(mid) < low[open_]
            left[open_[less]] = mid[less] + 1
            right[open_[~less]] = mid[~less]
            open_ = open_[left[open_] < right[open_]]
        found = np.full(len(x), -1, dtype=np.int64)
        inside = np.flatnonzero(left < end)
        same = inside[self._low(left[inside]) == low[inside]]
        found[same] = left[same]
        return found


class NgramTrie:
    """Contexts, monotone pointers to their successors, and a code of 16 bits per successor.

    Keys are sorted 64-bit numbers: context in the upper half, successor in the lower half.
    """

    def __init__(self, keys: np.ndarray, codes: np.ndarray):
        file = MappedFile()
        context = keys >> U64(32)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)
        self.n_contexts = len(first)
        self.contexts = EliasFano(context[first], 1 << 32, file)
        self.pointers = EliasFano(np.r_[first, len(keys)].astype(U64), len(keys) + 1, file)
        number = np.repeat(np.arange(self.n_contexts, dtype=U64), np.diff(np.r_[first, len(keys)]))
        # Successors grow within a context; the context's number in front makes the whole level grow.
        self.successors = EliasFano((number << U64(32)) | (keys & U64(0xFFFFFFFF)), max(1, self.n_contexts) << 32, file)
        self.codes = file.hold(codes.astype(np.uint16))

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Code of each sorted query key, 0 where it is missing."""
        found = np.zeros(len(keys), dtype=np.uint16)
        if not self.n_contexts or not len(keys):
            return found
        upper = keys >> U64(32)
        new = np.r_[True, upper[1:] != upper[:-1]]
        place = self.contexts.find(upper[new], 0, self.n_contexts)[np.cumsum(new) - 1]
        asked = np.flatnonzero(place >= 0)
        node = place[asked]
        begin, end = self.pointers.at(node).astype(np.int64), self.pointers.at(node + 1).astype(np.int64)
        x = (node.astype(U64) << U64(32)) | (keys[asked] & U64(0xFFFFFFFF))
        at = self.successors.find(x, begin, end)
        found[asked[at >= 0]] = self.codes[at[at >= 0]]
        return found
