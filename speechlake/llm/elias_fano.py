"""Elias-Fano sequences and a two-level n-gram trie over them, in one memory-mapped block of bytes."""

from __future__ import annotations

import mmap
import struct
import tempfile

import numpy as np

_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: _NTH[b, k]: position of the k-th set bit of byte b (8 where there is none).
_NTH = np.full((256, 9), 8, np.uint8)
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _NTH[_b, _k] = _p


class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts in unary with a running count for every 64 bits."""

    HEAD = struct.Struct("<qqq")

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        v = np.asarray(values, np.int64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        low = max(0, int(top // max(1, n)).bit_length() - 1)
        bits = ((v[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel() if low else np.zeros(0, np.uint8)
        lows = np.packbits(bits, bitorder="little").tobytes()
        upper = np.zeros((n + (top >> low) + 1 + 63) // 64 * 64 + 64, np.uint8)
        upper[(v >> low) + np.arange(n)] = 1
        high = np.packbits(upper, bitorder="little")
        runs = np.concatenate([[0], np.cumsum(_ONES[high].reshape(-1, 8).sum(1, dtype=np.int64))])
        lows += b"\0" * (-len(lows) % 8 + 8)
        return EliasFano.HEAD.pack(n, low, len(high)) + runs.astype(np.int64).tobytes() + high.tobytes() + lows

    def __init__(self, buffer, at: int = 0):
        self.n, self.low, n_high = self.HEAD.unpack_from(buffer, at)
        at += self.HEAD.size
        words = n_high // 8
        self.ones = np.frombuffer(buffer, np.int64, words + 1, at)
        self.zeros = 64 * np.arange(words + 1) - self.ones
        at += 8 * (words + 1)
        self.high = np.frombuffer(buffer, np.uint8, n_high, at).reshape(-1, 8)
        at += n_high
        size = (self.n * self.low + 7) // 8
        size += -size % 8 + 8
        self.lows = np.frombuffer(buffer, np.uint8, size, at)
        self.end = at + size

    def _select(self, k: np.ndarray, zero: bool) -> np.ndarray:
        """Position of the k-th (from 0) one, or zero, of the unary part."""
        runs = self.zeros if zero else self.ones
        w = np.searchsorted(runs, k, "right") - 1
        left = k - runs[w]
        word = self.high[w] ^ np.uint8(255 if zero else 0)
        seen = np.cumsum(_ONES[word], axis=1, dtype=np.int64)
        b = (seen <= left[:, None]).sum(1)
        at = np.arange(len(k))
        left = left - np.where(b > 0, seen[at, np.maximum(b - 1, 0)], 0)
        return w * 64 + b * 8 + _NTH[word[at, b], left]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.int64)
        bit = i * self.low
        at = (bit >> 3)[:, None] + np.arange(8)
        raw = self.lows[np.minimum(at, len(self.lows) - 1)].astype(np.uint64)
        word = (raw << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(1, dtype=np.uint64)
        return ((word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)).astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i, False) - i) << self.low) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is x or more; n if there is none."""
        x = np.asarray(x, np.int64)
        if not self.n:
            return np.zeros(len(x), np.int64)
        zeros = int(self.zeros[-1])
        h = x >> self.low
        out = np.full(len(x), self.n, np.int64)
        ok = np.flatnonzero(h < zeros - 1)
        h, rest = h[ok], x[ok] & ((1 << self.low) - 1)
        i = np.where(h > 0, self._select(np.maximum(h - 1, 0), True) - h + 1, 0)
        end = self._select(h, True) - h
        live = np.flatnonzero(i < end)
        while len(live):  # halve the values with the same high part
            middle = (i[live] + end[live]) >> 1
            less = self._low(middle) < rest[live]
            i[live[less]], end[live[~less]] = middle[less] + 1, middle[~less]
            live = live[i[live] < end[live]]
        out[ok] = np.minimum(i, self.n)
        return out


class Trie:
    """Contexts, pointers to their successors, successors, and an 8-bit code for each successor.

    Successors of a context are stored relative to it: its words plus one are added to the last value of the context
    before, which makes the whole level one rising sequence. Codes are steps of ``STEP`` of log10.
    """

    STEP = 0.04

    @staticmethod
    def pack(context: np.ndarray, word: np.ndarray, gain: np.ndarray) -> bytes:
        """From (context, word) pairs in rising order and the log10 gain of each."""
        n = len(context)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(first, n))
        last = word[np.append(first[1:], n) - 1] + 1 if n else np.zeros(0, np.int64)
        before = np.cumsum(last) - last
        level = word + 1 + np.repeat(before, size)
        codes = np.clip(np.rint(gain / Trie.STEP), 1, 255).astype(np.uint8)
        parts = [EliasFano.pack(x) for x in (context[first] if n else context, np.append(first, n), level)]
        return b"".join(parts) + codes.tobytes()

    def __init__(self, packed: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(packed)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.contexts = EliasFano(self.map)
        self.pointers = EliasFano(self.map, self.contexts.end)
        self.level = EliasFano(self.map, self.pointers.end)
        self.codes = np.frombuffer(self.map, np.uint8, self.level.n, self.level.end)

    def look_up(self, context: np.ndarray, word: np.ndarray, block: int = 1 << 17) -> np.ndarray:
        """The code of each pair, 0 where the trie has none."""
        out = np.zeros(len(context), np.uint8)
        if not self.level.n:
            return out
        for a in range(0, len(context), block):
            c, w = context[a : a + block], word[a : a + block]
            r = self.contexts.successor(c)
            hit = np.flatnonzero(r < self.contexts.n)
            hit = hit[self.contexts[r[hit]] == c[hit]]
            r, w = r[hit], w[hit]
            begin, end = self.pointers[r], self.pointers[r + 1]
            base = np.where(begin > 0, self.level[np.maximum(begin - 1, 0)], 0)
            i = self.level.successor(base + w + 1)
            found = np.flatnonzero(i < end)
            found = found[self.level[i[found]] == (base + w + 1)[found]]
            out[a + hit[found]] = self.codes[i[found]]
        return out
