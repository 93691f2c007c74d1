"""Operator 5: substring deduplication over a log-structured fingerprint index.

Every window of ``width`` consecutive words has a fingerprint: the smallest hash among its
``gram``-word sequences. Documents arrive in batches. A batch's sorted fingerprints are merge-joined,
bucket by bucket, with the immutable sorted runs of all earlier batches; what occurs in an earlier
run or in two documents of the batch is a hit. The batch's own fingerprints become a new run; runs
are compacted into one when there are more than ``max_runs``. Equal windows have equal
fingerprints, so hits never miss a repeated window; they are then verified: only windows with a
hit fingerprint are compared, by 96 bits of two unrelated hashes of their words, and matched
exactly across all documents; the few windows that very many rows have are joined by broadcast, so no task holds one of them whole.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Defined cases: null or empty text has no words;
texts shorter than a window lose none; exact copies of a text with a smaller ``doc_id`` lose every
word (if they have a window); rows with equal ``doc_id`` don't remove from each other; rows without an id keep all their words and remove none; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import grams, mix, pieces, words
from .bits import Filter, Layout, by_bucket, pack
from .runtime import drop_path, partitions, scratch, small, stored

WIDTH, GRAM = 13, 7
#: Hit fingerprints as a filter of a fixed size; too full, it only lets more windows be verified.
HITS = Layout(bits=1 << 26, buckets=64, hashes=2)
RUN = "bucket long, keys binary"
#: Windows with more than this part of all suspected rows are broadcast; there are at most so many.
POPULAR = 1000
#: Batches of the registered query and runs that the index holds: the last batch finds compacted history.
BATCHES, RUNS = 3, 1


def packed(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys as differences in byte planes: the upper planes are nearly all zeros, which compress away."""
    return np.diff(keys, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _window_prints(w, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, fingerprint) of every window that lies in one text."""
    g = grams(w.hashes(), gram)
    at = np.flatnonzero(w.room() >= width)
    if not len(at):
        return at, np.empty(0, np.uint64)
    low = g.copy()
    for j in range(1, width - gram + 1):
        np.minimum(low[: len(g) - j], g[j:], out=low[: len(g) - j])
    # the smallest of many hashes is small: mixing again spreads fingerprints over the buckets
    return at, mix(low[at] + np.uint64(1))


def fingerprint_rows(docs: DataFrame, width: int, gram: int, buckets: int) -> DataFrame:
    """(bucket, once, twice): each task's distinct fingerprints, 32 bits below the bucket's, sorted;
    ``twice`` holds those that two of its documents have."""
    shift = buckets.bit_length() - 1

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = seq = 0

        def flush():
            key = np.concatenate([h[0] for h in held])
            doc = np.concatenate([h[1] for h in held])
            held.clear()
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = key[1:] != key[:-1]
            again = np.zeros(len(key), bool)
            again[1:] = ~fresh[1:] & (doc[1:] != doc[:-1])
            start = np.flatnonzero(fresh)
            multi = np.logical_or.reduceat(again, start) if len(start) else np.empty(0, bool)
            key = key[start]
            top = (key >> np.uint64(64 - shift)).astype(np.int64)
            rest = ((key >> np.uint64(32 - shift)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            return pa.RecordBatch.from_pylist(
                [{"bucket": b, "once": packed(k), "twice": packed(k[m])} for b, k, m in by_bucket(top, rest, multi)],
                schema=pa.schema([("bucket", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())]))

        for batch in batches:
            for _, _, buf, at in pieces(batch.column(0)):
                w = words(buf, at)
                i, low = _window_prints(w, width, gram)
                if len(i):
                    own = w.owner()[i] + seq
                    new = np.ones(len(i), bool)
                    new[1:] = (low[1:] != low[:-1]) | (own[1:] != own[:-1])
                    held.append((low[new], own[new]))
                    size += int(new.sum())
                seq += len(at) - 1
                if size > 3_000_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(local, "bucket long, once binary, twice binary")


class FingerprintIndex:
    """Sorted runs of historical window fingerprints, as Parquet files in the shared folder.

    ``add`` returns the hits of a batch and leaves one run more. Runs are never changed; ``compact``
    merges all of them into one and drops the parts. The index may outlive the session: give the
    same ``path`` again.
    """

    def __init__(self, spark: SparkSession, path: str, width: int = WIDTH, gram: int = GRAM, buckets: int = 64, max_runs: int = RUNS):
        self.spark, self.path, self.width, self.gram, self.buckets, self.max_runs = spark, path, width, gram, buckets, max_runs
        self.runs: list[str] = []
        self.made = 0
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(fs_path):  # an index of an earlier session; only finished runs count
            found = [s.getPath() for s in fs.listStatus(fs_path)]
            done = [p for p in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
            self.runs = sorted((str(p) for p in done), key=lambda p: int(p.rpartition("-")[2]))
            self.made = 1 + max((int(str(p).rpartition("-")[2]) for p in found), default=-1)

    def _new(self) -> str:
        self.made += 1
        return f"{self.path}/run-{self.made - 1}"

    def history(self) -> DataFrame:
        if not self.runs:
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).option("recursiveFileLookup", "true").parquet(*self.runs)

    def add(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """(bucket, hits) of a batch: fingerprints found in an earlier run or in two documents of it. Nothing is compacted
        after the ``last`` batch of an index that goes away."""

        def merged(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
            kind = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("hits", pa.binary())])
            runs, once, twice = ([unpacked(x) for x in t.column(c).to_pylist()] for t, c in ((old, "keys"), (new, "once"), (new, "twice")))
            if not once:
                return kind.empty_table()
            keys, count = np.unique(np.concatenate(once), return_counts=True)
            hit = count > 1
            for run in [*runs, np.unique(np.concatenate(twice))]:  # each is sorted: a merge join
                if len(run):
                    at = np.searchsorted(run, keys)
                    hit |= run[np.minimum(at, len(run) - 1)] == keys
            return pa.Table.from_pylist([{"bucket": key[0].as_py(), "keys": packed(keys), "hits": packed(keys[hit])}], schema=kind)

        rows = fingerprint_rows(docs, self.width, self.gram, self.buckets)
        run = self._new()
        joined = self.history().groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(merged, "bucket long, keys binary, hits binary")
        joined.write.parquet(run)
        self.runs.append(run)
        hits = stored(self.spark.read.parquet(run).select("bucket", "hits"))
        if len(self.runs) > self.max_runs and not last:
            self.compact()
        return hits

    def compact(self) -> None:
        """Merge all runs into one sorted run; the old ones go once it is written."""

        def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = np.unique(np.concatenate([unpacked(x) for b in batches for x in b.column("keys").to_pylist()]))
            yield pa.RecordBatch.from_pylist([{"bucket": key[0].as_py(), "keys": packed(keys)}], schema=pa.schema([("bucket", pa.int64()), ("keys", pa.binary())]))

        old, run = self.runs, self._new()
        self.history().groupBy("bucket").applyInArrow(merge, RUN).write.parquet(run)
        self.runs = [run]
        for path in old:
            drop_path(self.spark, path)


def _hit_filter(hits: list[DataFrame], buckets: int, layout: Layout) -> dict[int, bytes]:
    """The hits of all batches as segments of a filter of a fixed size."""
    shift = buckets.bit_length() - 1

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, bits = key[0].as_py(), np.zeros(layout.span, bool)
        for b in batches:
            for x in b.column("hits").to_pylist():
                k = (np.uint64(bucket) << np.uint64(64 - shift)) | (unpacked(x).astype(np.uint64) << np.uint64(32 - shift))
                bits[layout.places(k).ravel().astype(np.int64)] = True
        yield pa.RecordBatch.from_pylist([{"bucket": bucket, "bits": pack(bits)}], schema=pa.schema([("bucket", pa.int64()), ("bits", pa.binary())]))

    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    return {r["bucket"]: bytes(r["bits"]) for r in every.groupBy("bucket").applyInArrow(build, "bucket long, bits binary").collect()}


def _suspect_windows(docs: DataFrame, hits, width: int, gram: int, buckets: int, layout: Layout) -> DataFrame:
    """(doc_id, tag, pos, w1, w2) of the windows whose fingerprint is a hit."""
    low = np.uint64(32 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Filter(layout, hits.value)
        for batch in batches:
            ids, tags = batch.column("doc_id"), batch.column("tag").to_numpy(zero_copy_only=False)
            for lo, hi, buf, at in pieces(batch.column("text")):
                w = words(buf, at)
                i, key = _window_prints(w, width, gram)
                if not len(i):
                    continue
                i = i[held.maybe((key >> low) << low)]
                if not len(i):
                    continue
                own = w.owner()[i]
                w1, w2 = grams(w.hashes(0), width, 0)[i], grams(w.hashes(1), width, 1)[i]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, hi - lo).take(pa.array(own)), pa.array(tags[lo:hi][own]), pa.array((i - w.first[own]).astype(np.int32)),
                    pa.array(w1.view(np.int64)), pa.array((w2 >> np.uint64(32)).astype(np.uint32).view(np.int32))], names=["doc_id", "tag", "pos", "w1", "w2"])

    return docs.select("doc_id", "tag", "text").mapInArrow(run, "doc_id long, tag long, pos int, w1 long, w2 int")


def repeated_positions(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, layout: Layout = HITS) -> DataFrame:
    """(doc_id, tag, at): first words of windows that also start in a document of a smaller id.

    ``docs``: doc_id, tag (a hash of the text) and text, without later exact copies. Batches are
    ranges of ``doc_id``, so an incremental run over the same ranges finds the same.
    """
    spark = docs.sparkSession
    layout = layout.spread(partitions(spark))
    buckets = layout.buckets
    cuts = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] or []
    edges = [None, *sorted(set(cuts)), None]
    where = scratch(spark, "fingerprints")
    index, hits = FingerprintIndex(spark, where, width, gram, buckets), []
    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
        part = docs
        if lo is not None:
            part = part.where(F.col("doc_id") > lo)
        if hi is not None:
            part = part.where(F.col("doc_id") <= hi)
        hits.append(index.add(part, last=k == len(edges) - 2))
    held = spark.sparkContext.broadcast(_hit_filter(hits, buckets, layout))
    drop_path(spark, where)
    # written as Parquet: a document's rows share their id, so they take little more than their hashes
    path = scratch(spark, "suspects")
    _suspect_windows(docs, held, width, gram, buckets, layout).write.parquet(path)
    suspects = spark.read.parquet(path)
    seen = suspects.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    first = stored(seen.where("first < last").select("w1", "w2", "first", "n"))
    # at most POPULAR windows can each have more than a POPULAR-th of all rows: these few are broadcast, so that none of them meets
    # in one task; the others are joined by a shuffle, after a filter of a fixed size has dropped most that match nothing
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    popular = F.broadcast(first.where(F.col("n") > total / POPULAR).select("w1", "w2", "first"))
    rare = first.where(F.col("n") <= total / POPULAR).select("w1", "w2", "first")
    often = suspects.join(popular, ["w1", "w2"])
    known = spark.sparkContext.broadcast(_window_filter(rare, layout))
    rest = _maybe(suspects, known, layout).join(popular.select("w1", "w2"), ["w1", "w2"], "left_anti").join(rare, ["w1", "w2"])
    found = often.unionByName(rest).where("doc_id > first")
    out = stored(found.groupBy("doc_id", "tag").agg(F.collect_list("pos").alias("at")))
    drop_path(spark, path)
    held.destroy(), known.destroy()
    return out


def _window_filter(rare: DataFrame, layout: Layout) -> dict[int, bytes]:
    """The first hashes of the repeated windows as segments of a filter of a fixed size."""
    bits = layout.buckets.bit_length() - 1

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(layout.span, bool)
        for b in batches:
            flags[layout.places(b.column("w1").to_numpy(zero_copy_only=False).view(np.uint64)).ravel().astype(np.int64)] = True
        yield pa.RecordBatch.from_pylist([{"bucket": key[0].as_py(), "bits": pack(flags)}], schema=pa.schema([("bucket", pa.int64()), ("bits", pa.binary())]))

    keyed = rare.select(F.shiftrightunsigned("w1", 64 - bits).alias("bucket"), "w1")
    return {r["bucket"]: bytes(r["bits"]) for r in keyed.groupBy("bucket").applyInArrow(build, "bucket long, bits binary").collect()}


def _maybe(suspects: DataFrame, known, layout: Layout) -> DataFrame:
    """The rows whose window may be a repeated one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Filter(layout, known.value)
        for batch in batches:
            yield batch.filter(pa.array(held.maybe(batch.column("w1").to_numpy(zero_copy_only=False).view(np.uint64))))

    return suspects.mapInArrow(run, suspects.schema)


def dedup_substrings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text: words covered by no window that started earlier."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("tag", F.xxhash64("text"))
    # Later exact copies: all their windows start in the first one.
    ids = stored(base.select("doc_id", "tag", F.unhex(F.md5("text")).alias("digest")).where("doc_id is not null"))
    first = ids.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = stored(ids.join(first, "digest").where("doc_id > first").select("doc_id", "tag").distinct())
    copies = small(copies).withColumn("copy", F.lit(True))
    marked = base.join(copies, ["doc_id", "tag"], "left")
    gone = (repeated_positions(marked.where("copy is null and doc_id is not null").select("doc_id", "tag", "text"), width, gram, batches))
    every = marked.join(gone, ["doc_id", "tag"], "left").select("doc_id", "text", "copy", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy = batch.column("copy").to_pylist()
            hits = batch.column("at")
            spots, bound = hits.flatten().to_numpy(zero_copy_only=False), None
            counts = np.array([0 if x is None else x for x in pa.compute.list_value_length(hits).to_pylist()])
            bound = np.concatenate([[0], np.cumsum(counts)])
            n_words, n_removed, kept = [], [], []
            for lo, hi, buf, at in pieces(batch.column("text")):
                w = words(buf, at)
                data = buf.tobytes()
                for d in range(lo, hi):
                    a, b = int(w.first[d - lo]), int(w.first[d - lo + 1])
                    n = b - a
                    if copy[d] and n >= width:
                        n_words.append(n), n_removed.append(n), kept.append(b"")
                        continue
                    start, end = w.start[a:b].tolist(), w.end[a:b].tolist()
                    cover = np.zeros(n + 1, np.int64)
                    p = spots[bound[d] : bound[d + 1]]
                    np.add.at(cover, p, 1)
                    np.add.at(cover, np.minimum(p + width, n), -1)
                    keep = np.cumsum(cover)[:n] == 0
                    n_words.append(n), n_removed.append(n - int(keep.sum()))
                    kept.append(b" ".join(data[start[i] : end[i]] for i in np.flatnonzero(keep)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept_text"])

    return every.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def digests(docs: DataFrame) -> DataFrame:
    out = dedup_substrings(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
