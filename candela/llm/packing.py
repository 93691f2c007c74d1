"""Operator 7: best-fit packing by linear grouping.

Pieces longer than capacity/16 are large. Their lengths are cut into groups of equal cardinality and
rounded up to each group's longest. Configurations (multisets of rounded sizes that fit a sequence)
are chosen on the group counts alone: the longest size left, completed by the subset of the other
sizes that fills it best, as often as the counts allow. Then the actual pieces of a group take the
places of its size by their rank, which leaves every sequence some room; small pieces fill the rooms
by best fit, again on counts: histograms of rooms and of small lengths. So the driver sees two
histograms of at most ``capacity`` rows and a plan of bounded size, whatever the input; ranks are
computed in salted groups, so one length may hold any share of the pieces.

Defined cases: null or empty text is the closing id alone; repeated rows are packed separately;
a text of more than ``capacity`` ids is cut into pieces of ``capacity``, the first may be shorter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import partitions, stored
from .tokens import ByteBpe

CAPACITY, END, GROUPS = 1024, 2, 256


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.tiktoken", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each document's pieces."""
    kind = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ByteBpe(vocabulary).encode_whole
        for batch in batches:
            cols = [[] for _ in kind]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = np.append(encode(text or ""), np.uint32(END))
                n = len(data)
                first = n - capacity * ((n - 1) // capacity)
                lo, k = 0, 0
                while lo < n:
                    hi = first if lo == 0 else lo + capacity
                    own = data[lo:hi]
                    row = (doc, k, lo, hi - lo, zlib.crc32(own), *([own.view("<i4")] if with_ids else []))
                    for c, v in zip(cols, row):
                        c.append(v)
                    lo, k = hi, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind)], schema=kind)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def groups_of(counts: dict[int, int], k: int) -> list[tuple[int, int, int]]:
    """(shortest, longest, pieces) of groups of about equal cardinality, longest first."""
    total, out, have, top = sum(counts.values()), [], 0, None
    for length in sorted(counts, reverse=True):
        top = length if top is None else top
        have += counts[length]
        if have >= total / k:
            out.append((length, top, have))
            have, top = 0, None
    if have:
        out.append((length, top, have))
    return out


def configurations(sizes: list[tuple[int, int]], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(group, how many)]) that use up all counts. ``sizes``: (size, count), longest first."""
    left = [n for _, n in sizes]
    out = []
    for g, (size, _) in enumerate(sizes):
        while left[g]:
            take = [0] * len(sizes)
            take[g] = 1
            room = capacity - size
            # sums that a subset of the sizes left can reach, as bits of one number
            mask, reach, seen = (1 << (room + 1)) - 1, 1, []
            for j in range(g, len(sizes)):
                s = sizes[j][0]
                for _ in range(min(left[j] - take[j], room // s)):
                    more = reach | (reach << s) & mask
                    if more == reach:
                        break
                    seen.append((j, s, reach))
                    reach = more
                if reach >> room & 1:
                    break
            fill = reach.bit_length() - 1
            for j, s, before in reversed(seen):
                if fill and not before >> fill & 1:
                    take[j] += 1
                    fill -= s
            times = min(left[j] // m for j, m in enumerate(take) if m)
            for j, m in enumerate(take):
                left[j] -= m * times
            out.append((times, [(j, m) for j, m in enumerate(take) if m]))
    return out


def small_plan(small: dict[int, int], rooms: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit on counts: (length, first rank, pieces, room class, first rank in it) and the number of
    new sequences, whose room class is capacity + 1. A room class holds its sequences by rank."""
    level = {r: [(r, 0, n)] for r, n in rooms.items() if n}
    out, fresh = [], 0
    for length in sorted(small, reverse=True):
        rank, left = 0, small[length]
        while left:
            fit = min((r for r in level if r >= length), default=None)
            if fit is None:
                n = -(-left // (capacity // length))
                level[capacity] = [(capacity + 1, fresh, n)]
                fresh += n
                fit = capacity
            cls, at, n = level[fit].pop()
            if not level[fit]:
                del level[fit]
            m = min(n, left)
            out.append((length, rank, m, cls, at))
            if n > m:
                level.setdefault(fit, []).append((cls, at + m, n - m))
            if fit > length:
                level.setdefault(fit - length, []).append((cls, at, m))
            rank, left = rank + m, left - m
    return out, fresh


def ranked(df: DataFrame, key: str, order: list[str], to: str) -> DataFrame:
    """Ranks from 0 within ``key``. Large keys are dealt over salts; each salt starts where those
    before it end."""
    salts = 4 * partitions(df.sparkSession)
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    starts = df.groupBy(key, "_salt").count()
    starts = starts.select(key, "_salt", (F.sum("count").over(Window.partitionBy(key).orderBy("_salt")) - F.col("count")).alias("_from"))
    local = df.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)))
    return local.join(starts, [key, "_salt"]).withColumn(to, F.col("_from") + F.col("_n") - 1).drop("_salt", "_n", "_from")


def _lookup(df: DataFrame, key: str, segments: dict[int, list[tuple]], schema: str, body) -> DataFrame:
    """Apply ``body(segment columns, offset in the segment)`` to each row's segment, found by binary search."""
    held = df.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in segments.items()})
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            keys, ranks = batch.column(key).to_numpy(), batch.column("rank").to_numpy()
            order = np.argsort(keys, kind="stable")
            made: list[np.ndarray] | None = None
            for own in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
                if len(own):
                    seg = table[int(keys[own[0]])]
                    at = np.searchsorted(seg[:, 0], ranks[own], side="right") - 1
                    got = body(seg[at], ranks[own] - seg[at, 0])
                    made = made or [np.zeros(len(keys), np.int64) for _ in got]
                    for m, g in zip(made, got):
                        m[own] = g
            if made:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, made)], names=[*names, *(x.split()[0] for x in schema.split(", "))])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, {schema}")


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. Token ids, if there, wait aside under a row number and join the
    finished places, so that only narrow rows are ranked and sorted."""
    wide = None
    if "ids" in pieces.columns:
        wide = stored(pieces.withColumn("_row", F.monotonically_increasing_id()))
        pieces = wide.drop("ids")
    else:
        pieces = stored(pieces)
    id_cols = ["doc_id", "piece", "ids_crc32"]
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    edge = capacity // 16
    large = {k: v for k, v in counts.items() if k > edge}
    small = {k: v for k, v in counts.items() if k <= edge}
    cut = groups_of(large, groups) if large else []
    plan = configurations([(top, n) for _, top, n in cut], capacity)
    segments: dict[int, list[tuple]] = {}
    used, total = [0] * len(cut), 0
    for times, parts in plan:
        for g, m in parts:
            segments.setdefault(g, []).append((used[g], total, m))
            used[g] += m * times
        total += times
    group_of = F.lit(-1)
    bounds = F.array(*[F.lit(low) for low, _, _ in cut]) if cut else None
    if cut:  # groups are listed from the longest: the group is the number of lower bounds above the length
        group_of = F.size(F.filter(bounds, lambda b: b > F.col("length")))
    big = pieces.where(F.col("length") > edge).withColumn("grp", group_of.cast("long"))
    placed = _lookup(ranked(big, "grp", id_cols, "rank"), "grp", segments, "sequence_id long", lambda s, d: [s[:, 1] + d // np.maximum(s[:, 2], 1)])
    placed = stored(placed.drop("grp", "rank"))
    if small:
        room = placed.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room")).where("room > 0")
        rooms = stored(ranked(room, "room", ["sequence_id"], "place"))
        have = {r["room"]: r["count"] for r in rooms.groupBy("room").count().collect()}  # at most ``capacity`` rows
        fills, _ = small_plan(small, have, capacity)
        by_length: dict[int, list[tuple]] = {}
        for length, rank, _, cls, at in fills:
            by_length.setdefault(length, []).append((rank, cls, at))
        little = ranked(pieces.where(F.col("length") <= edge), "length", id_cols, "rank")
        found = _lookup(little, "length", by_length, "room long, place long", lambda s, d: [s[:, 1], s[:, 2] + d])
        new = found.where(F.col("room") > capacity).withColumn("sequence_id", F.col("place") + total)
        old = found.where(F.col("room") <= capacity).join(rooms.select("room", "place", "sequence_id"), ["room", "place"])
        placed = placed.unionByName(old.select(*placed.columns)).unionByName(new.select(*placed.columns))
    w = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *id_cols)
    out = placed.withColumn("offset", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    return out if wide is None else stored(out).join(wide.select("_row", "ids"), "_row").drop("_row")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row for each piece, with its token ids (array<int>) if asked for."""
    out = pack(token_pieces(docs, capacity, with_ids=with_ids), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
