"""Whole texts as NumPy arrays: words, word hashes and word n-grams of an Arrow batch.

A word is ``[^\\x20\\x09-\\x0D]+`` over code points. All six separators are single UTF-8
bytes, so the split is done on bytes without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_GRAM = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n + 1:
        size = max(n + 1, 1 << 20)
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(size, base, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[which] = (out[0], out[1])
    return have


@dataclass
class Words:
    buf: np.ndarray  # bytes of the chunk
    start: np.ndarray  # byte position of each word
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of words at the end

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; ``which`` selects one of two unrelated ones."""
        if not len(self.start):
            return np.empty(0, U64)
        up, down = _powers(len(self.buf), which)
        sums = np.empty(len(self.buf) + 1, U64)
        sums[0] = 0
        np.cumsum((self.buf.astype(U64) + U64(1)) * up[: len(self.buf)], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * down[self.start]
        return mix(h + (self.end - self.start).astype(U64))

    def room(self) -> np.ndarray:
        """For each word: words from it to the end of its text, itself included."""
        counts = np.diff(self.first)
        return np.repeat(self.first[1:], counts) - np.arange(len(self.start))

    def owner(self) -> np.ndarray:
        """For each word: the index of its text in the chunk."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def grams(hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A hash of every n consecutive entries; entry i covers i .. i+n-1 and may cross texts."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, U64)
    acc = np.full(size, n, U64)
    for j in range(n):
        acc *= U64(_GRAM[which])
        acc += hashes[j : j + size]
    return mix(acc)


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls become empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.fill_null("") if col.null_count else col
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


def pieces(col: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    data, at = raw(col)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(buf: np.ndarray, at: np.ndarray, lower: bool = False) -> Words:
    """The words of the texts that lie at ``at`` in ``buf``."""
    if not len(buf):
        return Words(buf, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64))
    if lower:
        buf = _LOWER[buf]
    ink = ~_SPACE[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    before[at[:-1][at[:-1] < len(buf)]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    start = np.flatnonzero(ink & ~before)
    return Words(buf, start, np.flatnonzero(ink & ~after) + 1, np.searchsorted(start, at))


def text_bytes(col: pa.Array) -> list[bytes]:
    """Each text of a string column as UTF-8; null as empty."""
    col = col.fill_null("") if col.null_count else col
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()
