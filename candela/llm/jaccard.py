"""Operator 6: n-gram Jaccard self-join, with prefix filters under several global token orders.

A document's set holds the hashes of its distinct n-word shingles (A-Z lower-cased). Two sets with
Jaccard similarity of at least t share a token among the first |x| - ceil(t |x|) + 1 tokens of each,
whatever global order of tokens is taken. Two orders are used; in both, tokens that many prefixes
have come last (a fixed-size filter knows them), the others by one of two hashes. Candidates must
share a prefix token under every order:

1. for each order, the (token, size class) pairs that two different sets have in their prefixes are
   found first: only sets of the same or the next size class can be similar. A set that has none of
   them under some order is no candidate of any set and goes no further;
2. the rest meet at their tokens of the first order, with their sizes, parity sketches and one
   signature of their tokens for each other order. A pair is a candidate only if it shares a token under the
   first order, its signatures meet under every other one (the filters intersected, pair by pair), and sizes
   and sketches allow similarity (never wrongly denied). Groups of up to POPULAR sets form their pairs; larger ones
   are tied together, each set compared only with those not reached yet. One tie for each set and bucket
   leaves the task, never all pairs; components of the ties are blocks that no link crosses;
3. blocks are verified exactly, by products of 0/1 matrices of sets and shared tokens. Blocks of
   more than ``unit`` sets, or of that many times UNIT_TOKENS tokens, are salted; each pair of salts
   is a task of its own.

Equal sets count as one class from the start: copies are never expanded. Classes are known by their sets'
digests throughout; ids come in at the end. Defined cases: null, empty or blank text has an empty set, links with
nothing and is its own component; fewer than n words are one shingle, the whole sequence; rows with equal or null
``doc_id`` are separate rows, linked by their texts like any others; a class or component of null ids only has a null
id. Other columns are ignored; ``one_of_each`` passes them on, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import grams, mix, pieces, raw, words
from .bits import Filter, Layout, by_bucket, pack
from .graph import components
from .runtime import partitions, shared_dir, small, stored

U64 = np.uint64
#: Tokens in more prefixes than this come last in every order.
POPULAR = 32
COMMON = Layout(bits=1 << 25, buckets=64, hashes=2)
#: Tokens that two different sets share in their prefixes.
SHARED = Layout(bits=1 << 26, buckets=64, hashes=2)
UNIT = 500
#: A salt holds at most about so many tokens for each of ``unit`` sets, so blocks of long texts are cut finer.
UNIT_TOKENS = 1000
#: A task sends on an Arrow batch at about so many bytes.
BATCH_BYTES = 4 << 20
#: A task sends on what it holds at so many tokens (8 bytes each, several times that while they are sorted).
FLUSH = 1_000_000
COLUMNS = 2048
#: Bits of a set's signature of its prefix tokens under an order.
SIGN = 256


def sets_of(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    for _, _, buf, at in pieces(column):
        w = words(buf, at, lower=True)
        h = w.hashes()
        g = grams(h, n)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            if b - a >= n:
                yield np.unique(g[a : b - n + 1])
            elif b > a:
                yield grams(h[a:b], b - a) ^ U64(b - a)
            else:
                yield np.empty(0, U64)


def runs(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows of about BATCH_BYTES of the string column."""
    lo = 0
    _, at = raw(batch.column(column))
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BATCH_BYTES, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def short(tokens: np.ndarray, layout: Layout) -> np.ndarray:
    """32 bits of each token below those of its bucket: all that is shuffled to build a filter. Tokens
    that agree in them count as one, so a filter may hold more tokens, never fewer."""
    return ((tokens << U64(layout.buckets.bit_length() - 1)) >> U64(32)).astype(np.uint32)


def filter_keys(bucket: np.ndarray | int, low: np.ndarray, layout: Layout, level: np.ndarray | int = 0) -> np.ndarray:
    """The filter's 64-bit keys of tokens known by bucket and ``short``, and of a size class if given."""
    top = 64 - (layout.buckets.bit_length() - 1)
    low = low.astype(U64)
    own = ((low << U64(32)) | low) + np.asarray(level).astype(U64) * U64(0x9E3779B97F4A7C15)
    return (np.asarray(bucket).astype(U64) << U64(top)) | (mix(own) & U64((1 << top) - 1))


def known(held: Filter, tokens: np.ndarray, level: int = 0) -> np.ndarray:
    return held.maybe(filter_keys(held.layout.bucket(tokens), short(tokens, held.layout), held.layout, level))


def size_class(n: int, percent: int) -> int:
    """Sets whose sizes allow similarity lie in the same or neighbouring classes (from 1)."""
    return 1 + int(math.log(n) / max(math.log(100 / percent) * 1.000001, 0.001))


def _key(tokens: np.ndarray, order: int) -> np.ndarray:
    return tokens if order == 0 else mix(tokens + U64(order))


def prefix(tokens: np.ndarray, size: int, order: int, common: Filter | None) -> np.ndarray:
    """The first ``size`` tokens in the order (common tokens last, then by hash)."""
    key = _key(tokens, order)
    if common is not None and len(tokens) > size:
        last = known(common, tokens)
        rare = tokens[~last]
        if len(rare) >= size:
            key = key[~last]
            return rare[np.argpartition(key, size - 1)[:size]]
        rest, need = tokens[last], size - len(rare)
        return np.concatenate([rare, rest[np.argpartition(key[last], need - 1)[:need]]])
    return tokens if len(tokens) <= size else tokens[np.argpartition(key, size - 1)[:size]]


def common_tokens(docs: DataFrame, n: int, percent: int, orders: int, layout: Layout) -> dict[int, bytes]:
    """Filter segments of the tokens that more than POPULAR documents have in a doubled prefix."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            keys, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_pylist(
                [{"bucket": b, "keys": short(k, layout).tobytes(), "counts": np.minimum(c, 255).astype(np.uint8).tobytes()} for b, k, c in by_bucket(layout.bucket(keys), keys, count)],
                schema=pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

        for batch in batches:
            for s in sets_of(batch.column(0), n):
                if len(s):
                    p = 2 * prefix_size(len(s), percent)
                    own = np.concatenate([prefix(s, p, o, None) for o in range(orders)])
                    own = np.unique(own) if orders > 1 else own
                    held.append(own)
                    size += len(own)
                    if size > FLUSH:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for b in batches:
            keys += [np.frombuffer(x, np.uint32) for x in b.column("keys").to_pylist()]
            counts += [np.frombuffer(x, np.uint8) for x in b.column("counts").to_pylist()]
        keys, counts = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys = keys[start][np.add.reduceat(counts, start) > POPULAR]
        bits = np.zeros(layout.span, bool)
        bits[layout.places(filter_keys(key[0].as_py(), keys, layout)).ravel().astype(np.int64)] = True
        yield pa.RecordBatch.from_pylist([{"bucket": key[0].as_py(), "bits": pack(bits)}], schema=pa.schema([("bucket", pa.int64()), ("bits", pa.binary())]))

    parts = docs.select("text").mapInArrow(local, "bucket long, keys binary, counts binary")
    return {r["bucket"]: bytes(r["bits"]) for r in parts.groupBy("bucket").applyInArrow(merge, "bucket long, bits binary").collect()}


def set_digests(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, tag, n_shingles and a 128-bit digest (d1, d2) of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), *_digest(s)) for s in sets_of(batch.column("text"), n)]
            size, d1, d2 = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64())], names=["doc_id", "tag", "n_shingles", "d1", "d2"])

    return docs.select("doc_id", "tag", "text").mapInArrow(run, "doc_id long, tag long, n_shingles long, d1 long, d2 long")


class Seen:
    """The digests of the sets that a task has met lately: a copy's second set is skipped. Bounded; an
    overflow only lets copies through, which count as one set later on."""

    def __init__(self, most: int = 200_000):
        self.most, self.held = most, set()

    def new(self, digest: int) -> bool:
        if digest in self.held:
            return False
        if len(self.held) >= self.most:
            self.held.clear()
        self.held.add(digest)
        return True


def _digest(s: np.ndarray) -> tuple[int, int]:
    """Sums of two unrelated mixes of the tokens: equal for equal sets."""
    a, b = mix(s).sum(dtype=U64), mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _prefix_rows(s: np.ndarray, percent: int, order: int, common: Filter) -> np.ndarray:
    return prefix(s, prefix_size(len(s), percent), order, common)


def shared_tokens(docs: DataFrame, n: int, percent: int, orders: int, common, layout: Layout, shared: Layout) -> list[dict[int, bytes]]:
    """For each order, filter segments of the (token, size class) pairs of sets that have the token in their
    prefix, as another set of that or a neighbouring class does."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_filter, seen = Filter(layout, common.value), Seen()
        tokens, sets, size = [[] for _ in range(orders)], [], 0
        names = ("o", "bucket", "tokens", "levels", "sets", "more")
        kinds = pa.schema([(c, pa.int64() if c in ("o", "bucket") else pa.binary()) for c in names])

        def flush():
            own = np.array(sets, np.int64).reshape(-1, 2)
            for o in range(orders):
                t, at = np.concatenate(tokens[o]), np.repeat(np.arange(len(own)), [len(x) for x in tokens[o]])
                tokens[o].clear()
                lv, d = own[at, 0], own[at, 1]
                order = np.lexsort((d, lv, t))
                t, lv, d = t[order], lv[order], d[order]
                fresh = np.ones(len(t), bool)
                fresh[1:] = (t[1:] != t[:-1]) | (lv[1:] != lv[:-1])
                start = np.flatnonzero(fresh)
                # a pair's first set, and whether this task knows another one
                more = np.add.reduceat(np.concatenate([[0], (d[1:] != d[:-1]) & ~fresh[1:]]), start) > 0
                t, lv, d = t[start], lv[start].astype(np.uint16), d[start]
                yield pa.RecordBatch.from_pylist(
                    [{"o": o, "bucket": b, "tokens": short(x, shared).tobytes(), "levels": y.tobytes(), "sets": z.tobytes(), "more": m.tobytes()} for b, x, y, z, m in by_bucket(shared.bucket(t), t, lv, d, more)], schema=kinds)
            sets.clear()

        for batch in batches:
            for s in sets_of(batch.column(0), n):
                if len(s) and seen.new(d1 := _digest(s)[0]):
                    sets.append((size_class(len(s), percent), d1))
                    for o in range(orders):
                        tokens[o].append(p := _prefix_rows(s, percent, o, held_filter))
                        size += len(p)
                    if size > FLUSH:
                        yield from flush()
                        size = 0
        if size:
            yield from flush()

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[], [], [], []]
        for b in batches:
            for c, name, kind in zip(cols, ("tokens", "levels", "sets", "more"), (np.uint32, np.uint16, np.int64, bool)):
                c += [np.frombuffer(x, kind) for x in b.column(name).to_pylist()]
        t, lv, d, more = (np.concatenate(c) for c in cols)
        order = np.lexsort((lv, t))
        t, lv, d, more = t[order], lv[order].astype(np.int64), d[order], more[order]
        start = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (lv[1:] != lv[:-1])]))
        two = np.logical_or.reduceat(more, start) | (np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start))
        t, lv = t[start], lv[start]
        beside = (t[1:] == t[:-1]) & (lv[1:] == lv[:-1] + 1)  # sets of different classes are different sets
        two[1:] |= beside
        two[:-1] |= beside
        bits = np.zeros(shared.span, bool)
        bits[shared.places(filter_keys(key[1].as_py(), t[two], shared, lv[two])).ravel().astype(np.int64)] = True
        yield pa.RecordBatch.from_pylist([{"o": key[0].as_py(), "bucket": key[1].as_py(), "bits": pack(bits)}], schema=pa.schema([("o", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())]))

    parts = docs.select("text").mapInArrow(local, "o long, bucket long, tokens binary, levels binary, sets binary, more binary")
    out: list[dict[int, bytes]] = [{} for _ in range(orders)]
    for r in parts.groupBy("o", "bucket").applyInArrow(merge, "o long, bucket long, bits binary").collect():
        out[r["o"]][r["bucket"]] = bytes(r["bits"])
    return out


def sketch_level(n: int) -> int:
    """log2 of the sketch's bits: between the set's size and twice it, 64 to 8192."""
    return min(max(int(n - 1).bit_length(), 6), 13)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the numbers of tokens at each place. Sets that differ in d tokens differ in at most
    d bits, also after both are folded to fewer bits."""
    m = 1 << sketch_level(len(s))
    odd = np.bincount((s >> U64(17)).astype(np.int64) & (m - 1), minlength=m) & 1
    return np.packbits(odd.astype(bool), bitorder="little")


def signature(tokens: np.ndarray) -> np.ndarray:
    """A filter of SIGN bits of a few tokens: those of sets that share one have a bit in common."""
    bits = np.zeros(SIGN, bool)
    bits[(mix(tokens) >> U64(20)).astype(np.int64) % SIGN] = True
    return np.packbits(bits).view(U64)


class Sketches:
    """Sizes, sketches (by level) and the other orders' signatures of many sets."""

    def __init__(self, sizes: np.ndarray, data: list[bytes], signs: np.ndarray, percent: int):
        self.sizes, self.signs, self.percent = sizes.astype(np.int64), signs, percent
        self.level = np.array([sketch_level(n) for n in sizes])
        self.row = np.zeros(len(sizes), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for lv in np.unique(self.level):
            at = np.flatnonzero(self.level == lv)
            self.row[at] = np.arange(len(at))
            self.of[int(lv)] = np.frombuffer(b"".join(data[i] for i in at), U64).reshape(len(at), -1)

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs: can the two sets be similar? Never false for sets that are."""
        na, nb = self.sizes[a], self.sizes[b]
        out = 100 * np.minimum(na, nb) >= self.percent * np.maximum(na, nb)
        todo = np.flatnonzero(out)
        for at in np.array_split(todo, max(1, len(todo) // 20_000)):  # the other orders' prefixes must meet as well
            out[at] = (self.signs[a[at]] & self.signs[b[at]]).any(2).all(1)
        most = (100 - self.percent) * (na + nb) // (100 + self.percent)
        todo = np.flatnonzero(out)
        la, lb = self.level[a[todo]], self.level[b[todo]]
        for x, y in {(int(p), int(q)) for p, q in zip(*np.unique(np.stack([la, lb]), axis=1))} if len(todo) else ():
            for at in np.array_split(pick := todo[(la == x) & (lb == y)], max(1, len(pick) // 20_000)):
                u, v = self.of[x][self.row[a[at]]], self.of[y][self.row[b[at]]]
                while u.shape[1] > v.shape[1]:
                    u = u[:, : u.shape[1] // 2] ^ u[:, u.shape[1] // 2 :]
                while v.shape[1] > u.shape[1]:
                    v = v[:, : v.shape[1] // 2] ^ v[:, v.shape[1] // 2 :]
                out[at] = np.bitwise_count(u ^ v).sum(1, dtype=np.int64) <= most[at]
        return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _spread(members: np.ndarray, sk: Sketches) -> tuple[np.ndarray, np.ndarray]:
    """Edges that tie the components of ``close`` among the members of one large group: each set is
    compared with those not yet reached only."""
    left, a, b = members, [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            hit = sk.close(np.full(len(left), x), left)
            near = left[hit]
            front.extend(near.tolist())
            a.append(np.full(len(near), x)), b.append(near)
            left = left[~hit]
    return np.concatenate(a) if a else np.empty(0, np.int64), np.concatenate(b) if b else np.empty(0, np.int64)


def candidate_ties(docs: DataFrame, n: int, percent: int, orders: int, common, layout: Layout, shared_by_order, shared: Layout) -> DataFrame:
    """(a, b): ties (first digests of two sets) that connect whatever sets share a prefix token under the first
    order, may share one under every other order, and may be similar by size and sketch. At most one tie for each
    set and bucket of tokens."""
    wide = SIGN // 64 * (orders - 1)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_filter, filters, seen = Filter(layout, common.value), [Filter(shared, x) for x in shared_by_order.value], Seen()
        names = ("bucket", "tokens", "counts", "sets", "sizes", "signs", "sketches")
        kinds = pa.schema([(c, pa.int64() if c == "bucket" else pa.binary()) for c in names])
        tokens, about, signs, sketches = [], [], [], []

        def flush():
            t, at = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
            own, sign = np.array(about, np.int64), np.array(signs, U64).reshape(len(tokens), wide)
            bucket = shared.bucket(t)
            order = np.argsort(bucket, kind="stable")  # a set's tokens of one bucket stay together
            t, at, bucket = short(t[order], shared), at[order], bucket[order]
            start = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (at[1:] != at[:-1])]))
            count = np.diff(np.append(start, len(t))).astype(np.uint32)
            where = np.append(start, len(t))
            rows = []
            for b, i in by_bucket(bucket[start], np.arange(len(start))):
                who = at[start[i]]
                rows.append({"bucket": b, "tokens": t[where[i[0]] : where[i[-1] + 1]].tobytes(), "counts": count[i].tobytes(), "sets": own[who, 0].tobytes(), "sizes": own[who, 1].tobytes(),
                             "signs": sign[who].tobytes(), "sketches": b"".join([sketches[k] for k in who.tolist()])})
            for c in (tokens, about, signs, sketches):
                c.clear()
            return pa.RecordBatch.from_pylist(rows, schema=kinds)

        size = 0
        for batch in batches:
            for s in sets_of(batch.column(0), n):
                if not len(s) or not seen.new(d1 := _digest(s)[0]):
                    continue
                level, met = size_class(len(s), percent), []
                for o in range(orders):
                    p = _prefix_rows(s, percent, o, common_filter)
                    met.append(p := p[known(filters[o], p, level)])
                    if not len(p):
                        break
                else:
                    tokens.append(np.sort(met[0])), about.append((d1, len(s))), sketches.append(sketch(s).tobytes())
                    signs.append(np.concatenate([signature(p) for p in met[1:]]) if wide else ())
                    size += len(met[0]) * (len(sketches[-1]) + 8 * wide + 24)
                    if size > BATCH_BYTES:
                        yield flush()
                        size = 0
        if size:
            yield flush()

    def tie(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = {c: [] for c in ("tokens", "counts", "sets", "sizes", "signs", "sketches")}
        for batch in batches:
            for c, kind in zip(cols, (np.uint32, np.uint32, np.int64, np.int64, U64, np.uint8)):
                cols[c] += [np.frombuffer(x, kind) for x in batch.column(c).to_pylist()]
        parts, count, sets, size, sign, data = (np.concatenate(c) for c in cols.values())
        ids, first, row = np.unique(sets, return_index=True, return_inverse=True)
        ends = np.cumsum([(1 << sketch_level(x)) // 8 for x in size.tolist()])
        begins = np.concatenate([[0], ends[:-1]])
        sk = Sketches(size[first], [data[begins[i] : ends[i]].tobytes() for i in first], sign.reshape(len(sets), orders - 1, -1)[first] if wide else np.ones((len(ids), 1, 1), U64), percent)
        t, s = parts, np.repeat(row, count)
        order = np.lexsort((s, t))
        t, s = t[order], s[order]
        keep = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])])
        t, s = t[keep], s[keep]
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(np.append(start, len(t)))
        # small groups: their pairs at once; the same pair comes from many tokens and counts once
        pairs = [np.empty(0, np.int64)]
        for g in np.unique(size[(size > 1) & (size <= POPULAR)]):
            block = s[start[size == g][:, None] + np.arange(g)]
            i, j = np.triu_indices(g, 1)
            pairs.append(np.unique((block[:, i] * len(ids) + block[:, j]).ravel()))
        code = np.unique(np.concatenate(pairs))
        a, b = code // len(ids), code % len(ids)
        good = sk.close(a, b)
        root = _roots(len(ids), a[good], b[good])
        done = set()
        for lo, g in zip(start[size > POPULAR], size[size > POPULAR]):
            members = s[lo : lo + g]
            if (same := members.tobytes()) not in done:
                done.add(same)
                x, y = _spread(members, sk)
                root = _roots(len(ids), np.concatenate([np.arange(len(ids)), x]), np.concatenate([root, y]))
        other = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[root[other]]), pa.array(ids[other])], names=["a", "b"])

    parts = docs.select("text").mapInArrow(local, "bucket long, tokens binary, counts binary, sets binary, sizes binary, signs binary, sketches binary")
    return parts.groupBy("bucket").applyInArrow(tie, "a long, b long").distinct()


def links_of_units(members: DataFrame, n: int, percent: int) -> DataFrame:
    """(d1, links, root): for each unit and set in it, the number of rows linked to the set inside the
    unit and the smallest set of its component there. One row per set and unit.

    ``members``: d1, class size, block, own salt and number of salts, text (a repeated row may come more than
    once). Each set goes to one unit for each salt of its block; that list is built here, after the texts are there.
    """

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in runs(whole, "text")):
            data = [s.tobytes() for s in sets_of(batch.column("text"), n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("d1", "rows", "b", "salt", "s")), pa.array(data, pa.binary())], names=["d1", "rows", "b", "salt", "s", "tokens"])

    def verify(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        left, right = key[1].as_py(), key[2].as_py()
        own, once = np.unique(whole.column("d1").to_numpy(), return_index=True)  # sorted
        rows, salt = (whole.column(c).to_numpy()[once] for c in ("rows", "salt"))
        data = whole.column("tokens")
        tokens = [np.frombuffer(data[i].as_buffer(), U64) for i in once.tolist()]
        g = len(own)
        size = np.array([len(x) for x in tokens], np.float32)
        flat, owner = np.concatenate(tokens), np.repeat(np.arange(g), size.astype(np.int64))
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        col = np.cumsum(new) - 1
        shared = np.bincount(col) > 1
        number = np.cumsum(shared) - 1
        pick = shared[col]
        col, owner = number[col[pick]], owner[pick]  # sorted by column
        inter = np.zeros((g, g), np.float32)
        for lo in range(0, int(number[-1]) + 1, COLUMNS):
            a, b = np.searchsorted(col, [lo, lo + COLUMNS])
            x = np.zeros((g, COLUMNS), np.float32)
            x[owner[a:b], col[a:b] - lo] = 1
            inter += x @ x.T
        link = 100.0 * inter.astype(np.float64) >= percent * (size[:, None].astype(np.float64) + size[None, :] - inter)
        np.fill_diagonal(link, False)
        if left != right:
            link &= salt[:, None] != salt[None, :]
        count = link @ rows
        root = np.full(g, -1)
        for i in range(g):
            if root[i] < 0:
                root[i], front = i, np.array([i])
                while len(front):
                    front = np.flatnonzero(link[front].any(0) & (root < 0))
                    root[front] = i
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count), pa.array(own[root])], names=["d1", "links", "root"])

    made = members.select("d1", "rows", "b", "salt", "s", "text").mapInArrow(to_sets, "d1 long, rows long, b long, salt int, s int, tokens binary")
    each = made.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).select("d1", "rows", "salt", "tokens", "b", F.least("salt", "j").alias("l"), F.greatest("salt", "j").alias("r"))
    return each.groupBy("b", "l", "r").applyInArrow(verify, "d1 long, links long, root long")


def _groups(docs: DataFrame, n: int, percent: int, orders: int = 2, unit: int = UNIT, layout: Layout = COMMON) -> DataFrame:
    """For each row: doc_id, tag (a hash of its text), n_shingles, class_id, n_links, component_id, and ``first``:
    is its text that of the first row of its component (ids in order, nulls last)."""
    spark = docs.sparkSession
    shared_dir(spark)
    layout, shared = layout.spread(partitions(spark)), SHARED.spread(partitions(spark))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    info = stored(set_digests(base, n))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag"))
    classes = stored(info.where("n_shingles > 0").groupBy("d1", "d2").agg(head.alias("head"), F.count("*").alias("rows"), F.max("n_shingles").alias("size")))
    common = spark.sparkContext.broadcast(common_tokens(base, n, percent, orders, layout))
    both = spark.sparkContext.broadcast(shared_tokens(base, n, percent, orders, common, layout, shared))
    ties = stored(candidate_ties(base, n, percent, orders, common, layout, both, shared))
    common.destroy(), both.destroy()
    sets = stored(classes.join(components(ties).select(F.col("node").alias("d1"), F.col("label").alias("b")), "d1"))
    sizes = sets.groupBy("b").agg(F.count("*").alias("sets"), F.sum("size").alias("tokens")).where("sets > 1")
    s = F.ceil(F.greatest(F.col("sets") / unit, F.col("tokens") / (unit * UNIT_TOKENS))).cast("int")
    # 48 bytes each, however large the block; the text is found by the id and text hash of the class's first row
    members = sets.join(sizes, "b").withColumn("s", s).select("d1", F.col("head.doc_id").alias("id"), F.col("head.tag").alias("t"), "rows", "b", F.pmod(F.xxhash64("d1"), F.col("s")).cast("int").alias("salt"), "s")
    members = small(stored(members))
    texts = base.join(members, base.doc_id.eqNullSafe(members.id) & (base.tag == members.t))
    found = stored(links_of_units(texts.select("d1", "rows", "b", "salt", "s", "text"), n, percent))
    label = stored(components(found.where("d1 <> root").select(F.col("root").alias("a"), F.col("d1").alias("b"))))
    heads = label.join(sets.select("d1", "head"), label.node == sets.d1).groupBy("label").agg(F.min("head").alias("top"))
    tops = label.join(heads, "label").select(F.col("node").alias("d1"), "top")
    links = found.groupBy("d1").agg(F.sum("links").alias("links"))
    by_class = classes.join(links, "d1", "left").join(tops, "d1", "left")
    by_class = by_class.select("d1", "d2", "head", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("top", "head").alias("top"))
    out = info.join(by_class, ["d1", "d2"], "left")
    empty = F.col("n_shingles") == 0
    return out.select(
        "doc_id", "tag", "n_shingles",
        F.when(empty, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("component_id"),
        (empty | F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("tag") == F.col("top.tag"))).alias("first"),
    )


def similar_groups(docs: DataFrame, n: int = 5, percent: int = 80, orders: int = 2, unit: int = UNIT, layout: Layout = COMMON) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with an equal set), n_links, component_id for each row."""
    return _groups(docs, n, percent, orders, unit, layout).drop("tag", "first")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, the first by id (of repeated rows the one with the smallest hash of all columns), and
    all rows without words; all columns as they are."""
    first = stored(_groups(docs, n, percent).where("first").groupBy("doc_id", "tag", (F.col("n_shingles") == 0).alias("empty")).count())
    stay = small(first.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), ((F.col("count") > 1) & ~F.col("empty")).alias("_again")))
    at = docs.doc_id.cast("long").eqNullSafe(stay._id) & (F.xxhash64(F.coalesce(docs.text, F.lit(""))) == stay._tag)
    if first.where("count > 1 and not empty").isEmpty():
        return docs.join(stay, at, "left_semi")
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    kept = whole.join(stay, whole.id.eqNullSafe(stay._id) & (whole.hash == stay._tag))
    again = kept.where("_again").withColumn("n", F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.hash("row"), F.xxhash64("row")))).where("n = 1")
    return kept.where("not _again").select("row").unionByName(again.select("row")).select(*(F.col(f"row.`{c}`") for c in docs.columns))
