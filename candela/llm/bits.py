"""Bloom filters of a fixed size, cut into buckets so that tasks build them in parallel.

A 64-bit key belongs to the bucket of its top bits; inside it, other bits choose places.
Whatever the input's size, the whole filter has ``bits`` bits: that is the bound of what is
collected and broadcast. A filter that is too full answers "maybe" more often; callers only
do more exact work then.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U64 = np.uint64


@dataclass(frozen=True)
class Layout:
    bits: int = 1 << 26
    buckets: int = 64
    hashes: int = 2

    @property
    def span(self) -> int:
        return self.bits // self.buckets

    def spread(self, partitions: int) -> Layout:
        """The same bits in more buckets where the cluster uses more shuffle partitions."""
        buckets = max(self.buckets, min(1 << (2 * partitions - 1).bit_length(), self.bits // 1024))
        return Layout(self.bits, buckets, self.hashes)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(64 - (self.buckets.bit_length() - 1))).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """(hashes, n) places inside the keys' buckets."""
        a = keys * U64(0x9E3779B97F4A7C15)
        b = (keys ^ (keys >> U64(29))) * U64(0xBF58476D1CE4E5B9) | U64(1)
        return np.stack([((a + U64(i) * b) >> U64(20)) % U64(self.span) for i in range(self.hashes)])


def pack(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def unpack(data: bytes, span: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=span).astype(bool)


class Filter:
    """A finished filter: ``maybe(keys)`` is true for every key that was put in."""

    def __init__(self, layout: Layout, segments: dict[int, bytes]):
        self.layout = layout
        whole = np.zeros(layout.bits // 8, np.uint8)
        size = layout.span // 8
        for k, data in segments.items():
            whole[k * size : (k + 1) * size] = np.frombuffer(data, np.uint8)
        self.data = whole

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        base = self.layout.bucket(keys) * self.layout.span
        out = np.ones(len(keys), bool)
        for row in self.layout.places(keys):
            at = base + row.astype(np.int64)
            out &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def by_bucket(bucket: np.ndarray, *columns: np.ndarray):
    """(bucket, columns of its rows) for rows already sorted by bucket."""
    if not len(bucket):
        return
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(bucket)]])):
        yield int(bucket[lo]), *(c[lo:hi] for c in columns)
