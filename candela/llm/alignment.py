"""Operator 11: cross-tokenizer alignment by merge-path partitioning.

Both tokenisations of a text are sorted lists of byte ends. Merging them is a path through a grid, one step for each end;
its crossings with every ``PIECE``-th diagonal are found by binary search, all at once, and cut the merge into independent
pieces of equal work (an end that both share is never cut in two). Between two neighbouring ends lies exactly one
overlap of an A with a B token, so a piece emits its overlaps without seeing the others, and the ids up to its first
shared end, between shared ends, and behind its last one. A document's pieces are stitched in order: what is open behind one
piece's last shared end continues to the first one of the next. A document of one piece is finished where it is
tokenised; the pieces of longer ones are rows, dealt over all tasks, and meet again by document.

A pair's count is the number of documents that link it. Tasks count the distinct pairs of their documents before
anything is shuffled. The most frequent ``HEAD`` pairs at most (whole powers of two of the count) are looked up from a
broadcast of that bounded size; links to rarer pairs, few in each document and spread over many keys, meet their counts by a join.

Texts are tokenised once; their rows lie in the shared folder as Parquet. Defined cases: texts that are null, empty or not
given back byte for byte by both tokenizers have no tokens: zeros, and '' as hash; repeated rows count as documents of their
own; null ids stay; an empty table gives no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import partitions, scratch, stored
from .tokens import ByteBpe, PieceBpe

PIECE, HEAD, KEEP = 1 << 14, 1 << 20, 1 << 21
RESULT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"
PART = "row long, piece int, doc_id long, n_a long, n_b long, commons long, head_a string, head_b string, body string, tail_a string, tail_b string, keys binary, times binary"
LONG = "piece int, a_from long, b_from long, a_ids binary, b_ids binary"


class Part(NamedTuple):
    """What one piece emits. Ids are decimal, joined by commas; ``body`` holds whole groups."""

    commons: int
    head: tuple[str, str]
    body: str
    tail: tuple[str, str]
    keys: np.ndarray
    times: np.ndarray


def diagonals(a: np.ndarray, b: np.ndarray, every: int) -> np.ndarray:
    """(i, j) where the merge path of two sorted lists of ends crosses each ``every``-th diagonal, from (0, 0) to the
    end. Equal ends come from ``a`` first and stay together."""
    total = len(a) + len(b)
    d = np.arange(every, total, every)
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    more_a, more_b = np.append(a, -1), np.append(b, -1)  # so that every place can be looked up
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        right = open_ & (more_a[np.minimum(mid, len(a))] <= more_b[np.clip(d - mid - 1, 0, len(b))])
        lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
    i, j = lo, d - lo
    split = (i > 0) & (j < len(b)) & (more_a[np.maximum(i - 1, 0)] == more_b[j])
    ij = np.stack([i, j + split])
    out = np.concatenate([[[0], [0]], ij, [[len(a)], [len(b)]]], axis=1)
    return out[:, np.append(True, np.diff(out.sum(axis=0)) > 0)] if total else out[:, :1]


class Joiner:
    """Decimal ids with what follows them: a comma, a bar or a semicolon."""

    def __init__(self, size: int):
        self.table = np.array([[f"{i}{mark}" for i in range(size)] for mark in ",|;"], object)

    def text(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> str:
        """Groups in order, A before B in each; the last mark is cut off."""
        key = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(key, kind="stable")
        key, ids = key[order], np.concatenate([a, b])[order]
        last = np.append(key[1:] != key[:-1], True)[: len(key)]
        return "".join(self.table[np.where(last, 1 + key % 2, 0), ids])[:-1]

    def plain(self, ids: np.ndarray) -> str:
        return "".join(self.table[0, ids])[:-1]


def overlaps(a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray, na: int, nb: int, base: int, joiner: Joiner) -> Part:
    """One piece: ``na`` and ``nb`` ends are its own; one more id of each may follow, of the token that crosses its end."""
    a, b = a_ends[:na], b_ends[:nb]
    ends = np.concatenate([a, b])
    ends.sort(kind="stable")
    ends = ends[np.append(True, ends[1:] != ends[:-1])[: len(ends)]]
    at_a, at_b = np.searchsorted(a, ends), np.searchsorted(b, ends)  # the token that covers what lies before each end
    keys, times = np.unique(a_ids[at_a].astype(np.uint64) * np.uint64(base) + b_ids[at_b], return_counts=True)
    shared = ends[(a[np.minimum(at_a, na - 1)] == ends if na else False) & (b[np.minimum(at_b, nb - 1)] == ends if nb else False)]
    own_a, own_b = a_ids[:na], b_ids[:nb]
    if not len(shared):
        return Part(0, (joiner.plain(own_a), joiner.plain(own_b)), "", ("", ""), keys, times)
    ga, gb = np.searchsorted(shared, a), np.searchsorted(shared, b)
    k, inside_a, inside_b = len(shared), (ga > 0) & (ga < len(shared)), (gb > 0) & (gb < len(shared))
    return Part(k, (joiner.plain(own_a[ga == 0]), joiner.plain(own_b[gb == 0])), joiner.text(own_a[inside_a], own_b[inside_b], ga[inside_a], gb[inside_b]),
                (joiner.plain(own_a[ga == k]), joiner.plain(own_b[gb == k])), keys, times)


def stitch(parts: Iterable[Part]) -> tuple[int, int, str, np.ndarray, np.ndarray]:
    """Groups, links, the hash of the groups, the distinct pairs and their links of a document."""
    groups, links, digest, open_, keys, times = 0, 0, hashlib.sha256(), ([], []), [], []
    for p in parts:
        for side, text in zip(open_, p.head):
            if text:
                side.append(text)
        if p.commons:
            digest.update((";" if groups else "").encode() + "|".join(",".join(s) for s in open_).encode())
            if p.body:
                digest.update(f";{p.body}".encode())
            groups += p.commons
            open_ = tuple([t] if t else [] for t in p.tail)
        links += int(p.times.sum())
        keys.append(p.keys)
        times.append(p.times)
    if len(keys) == 1:
        return groups, links, digest.hexdigest(), keys[0], times[0]
    found, back = np.unique(np.concatenate(keys), return_inverse=True)
    return groups, links, digest.hexdigest(), found, np.bincount(back, np.concatenate(times)).astype(np.int64)


class Aligner:
    """Both vocabularies; built once in each task."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteBpe(a, special=None), PieceBpe(b)
        own_a, own_b = self.a.token_bytes(), self.b.token_bytes()
        self.bytes_a, self.bytes_b = (np.array([*x, b""], object)[:-1] for x in (own_a, own_b))
        self.len_a, self.len_b = (np.array([len(t) for t in x], np.int64) for x in (own_a, own_b))
        self.base = len(own_b)
        self.id = "<u2" if max(len(own_a), len(own_b)) <= 1 << 16 else "<u4"
        self.key = "<u4" if len(own_a) * len(own_b) < 1 << 32 else "<u8"
        self.joiner = Joiner(max(len(own_a), len(own_b)))

    def ends(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and byte ends of both sides; None where a side does not give the text back."""
        want = (" " + text).encode()
        a, b = self.a.encode_whole(" " + text), self.b.encode_text(text)
        if b"".join(self.bytes_a[a]) != want or b"".join(self.bytes_b[b]) != want:
            return None
        return a, np.cumsum(self.len_a[a]), b, np.cumsum(self.len_b[b])


def packed(keys: np.ndarray, times: np.ndarray, kind: str) -> tuple[bytes, bytes]:
    """Sorted keys as differences, which compress well, and their links."""
    return np.diff(keys.astype(np.uint64), prepend=np.uint64(0)).astype(kind).tobytes(), times.astype("<u4").tobytes()


def unpacked(keys: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(times, "<u4").astype(np.int64)
    return np.cumsum(np.frombuffer(keys, "<u4" if len(keys) == len(times) else "<u8").astype(np.int64)), n


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def aligned(docs: DataFrame, a: str = "byte_bpe_50k.tiktoken", b: str = "piece_bpe_32k.model", piece: int = PIECE) -> DataFrame:
    """``RESULT`` for each document: sizes, the groups' hash and the linked pairs with their links; kept as Parquet."""
    spark, ddl = docs.sparkSession, f"{RESULT}, {LONG}"
    wide, narrow = _schema(ddl), _schema(RESULT)
    parts = _schema(PART)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, row = Aligner(a, b), TaskContext.get().partitionId() << 33
        for batch in batches:
            out, held = [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                row += 1
                got = tools.ends(text) if text else None
                if got is None:
                    out.append((row, doc, 0, 0, 0, 0, "", b"", b"", *[None] * 5))
                    continue
                a_ids, a_ends, b_ids, b_ends = got
                cut = diagonals(a_ends, b_ends, piece) if len(a_ids) + len(b_ids) > piece else None
                if cut is None or cut.shape[1] == 2:
                    groups, links, digest, keys, times = stitch([overlaps(*got, len(a_ids), len(b_ids), tools.base, tools.joiner)])
                    out.append((row, doc, len(a_ids), len(b_ids), groups, links, digest, *packed(keys, times, tools.key), *[None] * 5))
                    held += 8 * len(keys)
                else:
                    for k in range(cut.shape[1] - 1):
                        (i0, j0), (i1, j1) = cut[:, k], cut[:, k + 1]
                        raw = [x.astype(tools.id).tobytes() for x in (a_ids[i0 : i1 + 1], b_ids[j0 : j1 + 1])]
                        own = [int(e[i - 1]) if i else 0 for e, i in ((a_ends, i0), (b_ends, j0))]
                        out.append((row, doc, len(a_ids), len(b_ids), i1 - i0, j1 - j0, None, None, None, k, *own, *raw))
                        held += sum(map(len, raw))
                if held > 1 << 23:
                    yield _batch(out, wide)
                    out, held = [], 0
            yield _batch(out, wide)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each piece on its own."""
        tools = Aligner(a, b)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                # the ends of a piece follow from its ids; n_groups and n_links hold how many ends are its own
                a_ids, b_ids = (np.frombuffer(r[c], tools.id) for c in ("a_ids", "b_ids"))
                a_ends, b_ends = r["a_from"] + np.cumsum(tools.len_a[a_ids]), r["b_from"] + np.cumsum(tools.len_b[b_ids])
                p = overlaps(a_ids, a_ends, b_ids, b_ends, r["n_groups"], r["n_links"], tools.base, tools.joiner)
                out.append((r["row"], r["piece"], r["doc_id"], r["n_a"], r["n_b"], p.commons, *p.head, p.body, *p.tail, *packed(p.keys, p.times, tools.key)))
            yield _batch(out, parts)

    def join(own: pa.Table) -> pa.Table:
        """The pieces of one document."""
        rows = own.sort_by("piece").to_pylist()
        groups, links, digest, keys, times = stitch(Part(r["commons"], (r["head_a"], r["head_b"]), r["body"], (r["tail_a"], r["tail_b"]), *unpacked(r["keys"], r["times"])) for r in rows)
        return pa.Table.from_batches([_batch([(*(rows[0][c] for c in ("row", "doc_id", "n_a", "n_b")), groups, links, digest, *packed(keys, times, "<u4" if len(rows[0]["keys"]) == len(rows[0]["times"]) else "<u8"))], narrow)])

    whole, cut_up = scratch(spark, "aligned"), scratch(spark, "stitched")
    docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tokenise, ddl).write.option("compression", "zstd").parquet(whole)
    rows, names = spark.read.parquet(whole), [f.name for f in narrow]
    pieces = rows.where("piece is not null").select("row", "piece", "doc_id", "n_a", "n_b", "n_groups", "n_links", "a_from", "b_from", "a_ids", "b_ids")
    emitted = pieces.repartition(partitions(spark), "row", "piece").mapInArrow(emit, PART)
    emitted.groupBy("row").applyInArrow(join, RESULT).write.option("compression", "zstd").parquet(cut_up)
    return rows.where("piece is null").select(*names).unionByName(spark.read.parquet(cut_up))


def pair_counts(rows: DataFrame, base: int) -> DataFrame:
    """key, n (documents that link the pair) and best (whether n is the highest of its A id) of every linked pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            own = [unpacked(k, t)[0] for k, t in zip(batch.column("keys").to_pylist(), batch.column("times").to_pylist())]
            if own:
                keys, back = np.unique(np.concatenate([keys, *own]), return_inverse=True)
                n = np.bincount(back, np.concatenate([n, *(np.ones(len(k), np.int64) for k in own)])).astype(np.int64)
            if len(keys) > KEEP:  # what a task holds stays bounded
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])
                keys, n = keys[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    counts = rows.select("keys", "times").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    mine = Window.partitionBy(F.floor(F.col("key") / base))  # at most one row for each B id
    return stored(counts.select("key", "n", (F.col("n") == F.max("n").over(mine)).alias("best")))


def frequent(counts: DataFrame, rows: int = HEAD) -> int:
    """The least power of two such that at most ``rows`` pairs have that count or more."""
    sizes = {r["k"]: r["n"] for r in counts.groupBy(F.length(F.bin("n")).alias("k")).agg(F.count("*").alias("n")).collect()}  # at most 64 rows
    have, k = 0, max(sizes, default=0) + 1
    while k > 1 and have + sizes.get(k - 1, 0) <= rows:
        have, k = have + sizes.get(k - 1, 0), k - 1
    return 1 << (k - 1)


def align(docs: DataFrame, a: str = "byte_bpe_50k.tiktoken", b: str = "piece_bpe_32k.model", piece: int = PIECE, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    rows = aligned(docs, a, b, piece)
    counts = pair_counts(rows, PieceBpe(b).size)
    least = frequent(counts, head)
    top = counts.where(F.col("n") >= least).orderBy("key").collect()  # at most ``head`` rows
    held = rows.sparkSession.sparkContext.broadcast(tuple(np.array([r[c] for r in top], np.int64) for c in ("key", "n", "best")))
    out = _schema("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")

    def known(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is held, and where."""
        at = np.searchsorted(held.value[0], keys)
        have = np.zeros(len(keys), bool) if not len(held.value[0]) else held.value[0][np.minimum(at, len(held.value[0]) - 1)] == keys
        return have, at[have]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, total = [], []
            for k, t in zip(batch.column("keys").to_pylist(), batch.column("times").to_pylist()):
                keys, times = unpacked(k, t)
                have, at = known(keys)
                best.append(int(times[have] @ held.value[2][at]))
                total.append(int(times[have] @ held.value[1][at]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out.names[:7]), pa.array(best, pa.int64()), pa.array(total, pa.int64())], schema=out)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links to pairs that are not held."""
        for batch in batches:
            for row, k, t in zip(batch.column("row").to_pylist(), batch.column("keys").to_pylist(), batch.column("times").to_pylist()):
                keys, times = unpacked(k, t)
                rare = ~known(keys)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rare.sum(), row)), pa.array(keys[rare]), pa.array(times[rare])], names=["row", "key", "times"])

    scored = rows.select(*out.names[:7], "keys", "times").mapInArrow(score, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in out))
    if least > 1:  # else every pair is held
        met = rows.select("row", "keys", "times").mapInArrow(rest, "row long, key long, times long").join(counts.where(F.col("n") < least), "key")
        more = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        scored = scored.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
