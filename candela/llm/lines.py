"""Operator 4: line deduplication with a once-seen and a twice-seen Bloom filter.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Every
task puts the key hashes of its documents into two local filters (seen once, seen again);
merging takes the union of both and adds to "twice" the places that two tasks' "once" filters
have in common. No key of two documents is ever missing from the merged twice-seen filter, so
only lines that it holds are shuffled, as exact keys with counts, to confirm how many documents
they occur in and to find their first occurrence. The filter has a fixed number of bits.

Defined cases: a null or empty text is one empty line; empty keys are never dropped (``min_chars``);
each row counts as a document of its own, so repeated rows count twice; a line that occurs twice in
one document counts once. First occurrence: smallest (doc_id, text's hash, line number), null ids last; so of rows with
one id but unlike texts, or without an id, one keeps the line. Rows equal in id and text are one document read twice and
keep the same lines. Empty tables give none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import text_bytes
from .bits import Filter, Layout, by_bucket, pack, unpack
from .runtime import BROADCAST_ROWS, partitions, shared_dir, stored

LAYOUT = Layout(bits=1 << 26, buckets=64, hashes=2)
NEWLINE = b"\n"
#: Dropped keys of at most so many bytes together are broadcast (the driver holds them too).
BROADCAST_BYTES = 32 << 20


def keys_of(text: bytes) -> list[bytes]:
    """The key of each line. bytes.lower and bytes.strip know ASCII only, as the key asks."""
    return [x.strip() for x in text.lower().split(NEWLINE)]


def wanted(keys: list[bytes], min_chars: int) -> set[bytes]:
    """Distinct keys of at least so many code points."""
    return {k for k in set(keys) if len(k) >= min_chars and (min_chars <= 1 or len(k.decode()) >= min_chars)}


def twice_seen(docs: DataFrame, min_chars: int, layout: Layout = LAYOUT) -> dict[int, bytes]:
    """Segments of the twice-seen filter by bucket: at most ``layout.bits`` bits in all."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[int] = []

        def flush():
            keys = np.array(seen, np.uint64)
            seen.clear()
            keys, count = np.unique(keys, return_counts=True)
            return pa.RecordBatch.from_pylist([
                {"bucket": b, "once": np.unique(layout.places(k)).astype(np.uint32).tobytes(),
                 "twice": np.unique(layout.places(k[c > 1])).astype(np.uint32).tobytes()}
                for b, k, c in by_bucket(layout.bucket(keys), keys, count)
            ], schema=pa.schema([("bucket", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())]))

        for batch in batches:
            for text in text_bytes(batch.column(0)):
                seen += [xxhash.xxh3_64_intdigest(k) for k in wanted(keys_of(text), min_chars)]
                if len(seen) > 4_000_000:
                    yield flush()
        if seen:
            yield flush()

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(layout.span, bool), np.zeros(layout.span, bool)
        for batch in batches:
            for a, b in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist()):
                came = np.frombuffer(a, np.uint32)
                twice[came[once[came]]] = True
                twice[np.frombuffer(b, np.uint32)] = True
                once[came] = True
        yield pa.RecordBatch.from_pylist([{"bucket": key[0].as_py(), "bits": pack(twice)}], schema=pa.schema([("bucket", pa.int64()), ("bits", pa.binary())]))

    parts = docs.select("text").mapInArrow(local, "bucket long, once binary, twice binary")
    merged = parts.groupBy("bucket").applyInArrow(merge, "bucket long, bits binary")
    return {r["bucket"]: bytes(r["bits"]) for r in merged.collect()}


def place(doc: int | None, text: bytes, line: int) -> tuple[bool, int, int, int]:
    """Where a line stands, in the order in which occurrences come."""
    return doc is None, doc or 0, xxhash.xxh3_64_intdigest(text) >> 1, line


PLACE = ("no_id", "doc", "tag", "line")


def repeated_lines(docs: DataFrame, min_docs: int, min_chars: int = 1, layout: Layout = LAYOUT, suspects: Broadcast | None = None) -> DataFrame:
    """(key, n_docs, first: ``PLACE``) of the keys found in at least ``min_docs`` documents.

    Suspects are summed in each task, then by Spark; a key that every document has sends one row
    from each task. ``min_docs`` must be 2 or more.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    layout = layout.spread(partitions(spark))
    suspects = suspects or spark.sparkContext.broadcast(twice_seen(docs, min_chars, layout))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Filter(layout, suspects.value)
        found: dict[bytes, list] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([
                pa.array(list(found), pa.binary()).cast(pa.string()), pa.array([v[0] for v in found.values()], pa.int64()),
                *(pa.array([v[1][i] for v in found.values()]) for i in range(len(PLACE))),
            ], names=["key", "n", *PLACE])
            found.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
                keys = keys_of(text)
                first: dict[bytes, int] = {}
                for i, k in enumerate(keys):
                    first.setdefault(k, i)
                own = list(wanted(keys, min_chars))
                if not own:
                    continue
                maybe = held.maybe(np.array([xxhash.xxh3_64_intdigest(k) for k in own], np.uint64))
                for k, hit in zip(own, maybe):
                    if hit:
                        old, at = found.get(k), place(doc, text, first[k])
                        if old is None:
                            found[k] = [1, at]
                        else:
                            found[k] = [old[0] + 1, min(at, old[1])]
            if len(found) > 500_000:
                yield flush()
        if found:
            yield flush()

    rows = docs.select("doc_id", "text").mapInArrow(exact, "key string, n long, no_id boolean, doc long, tag long, line long")
    total = rows.groupBy("key").agg(F.sum("n").alias("n_docs"), F.min(F.struct(*PLACE)).alias("first"))
    return total.where(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, layout: Layout = LAYOUT) -> DataFrame:
    """The rows with ``kept_text``, ``n_lines`` and ``n_dropped`` added (columns of these names are replaced).

    Lines whose key is found in at least ``min_docs`` documents go, all of them or all but the first
    occurrence. The dropped keys travel by broadcast if they are few and short, else by a join.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    spark = docs.sparkSession
    shared_dir(spark)
    layout = layout.spread(partitions(spark))
    suspects = spark.sparkContext.broadcast(twice_seen(docs, min_chars, layout))
    drop = stored(repeated_lines(docs, min_docs, min_chars, layout, suspects))
    some, size = drop.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    names = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    docs = docs.select(*(docs[f"`{c}`"] for c in names))
    if some <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        table = {r["key"].encode(): tuple(r["first"]) for r in drop.collect()}
        known = spark.sparkContext.broadcast(table)
        fed = docs.select(F.struct("doc_id", "text").alias("in"), *(F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(names)))
    else:
        fed = _with_own_drops(docs, drop, names, layout, suspects)
        known = None
    schema = "n_lines long, n_dropped long, kept_text string, " + ", ".join(f"c_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = known.value if known else None
        for batch in batches:
            kind = batch.column("in")
            own = kind.field("drops").to_pylist() if shared is None else None
            lines, gone, kept = [], [], []
            for i, (doc, text) in enumerate(zip(kind.field("doc_id").to_pylist(), text_bytes(kind.field("text")))):
                drops = shared if own is None else {x["key"].encode(): tuple(x["first"].values()) for x in own[i] or ()}
                raw, keys = text.split(NEWLINE), keys_of(text)
                if drops.keys().isdisjoint(keys):
                    lines.append(len(raw)), gone.append(0), kept.append(text)
                    continue
                left = [x for j, (x, k) in enumerate(zip(raw, keys)) if k not in drops or keep_first and drops[k] == place(doc, text, j)]
                lines.append(len(raw)), gone.append(len(raw) - len(left)), kept.append(NEWLINE.join(left))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *(batch.column(f"c_{i}") for i in range(len(names)))],
                names=["n_lines", "n_dropped", "kept_text", *(f"c_{i}" for i in range(len(names)))],
            )

    out = fed.mapInArrow(cut, schema)
    return out.select(*(F.col(f"c_{i}").alias(c) for i, c in enumerate(names)), "n_lines", "n_dropped", "kept_text")


def _with_own_drops(docs: DataFrame, drop: DataFrame, names: list[str], layout: Layout, suspects: Broadcast) -> DataFrame:
    """Beyond the broadcast bound: each text is joined with the dropped keys it holds. Only suspected lines are shuffled."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Filter(layout, suspects.value)
        for batch in batches:
            row, key = [], []
            for i, text in enumerate(text_bytes(batch.column("text"))):
                own = list(set(keys_of(text)))
                maybe = held.maybe(np.array([xxhash.xxh3_64_intdigest(k) for k in own], np.uint64))
                own = [k for k, hit in zip(own, maybe) if hit]
                row += [i] * len(own)
                key += own
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("tag").take(at), pa.array(key, pa.binary()).cast(pa.string())], names=["doc_id", "tag", "key"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    lines = rows.mapInArrow(keyed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tag long, key string").distinct()
    own = lines.join(drop, "key").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("key", "first")).alias("drops"))
    own = own.withColumnsRenamed({"doc_id": "o_doc", "tag": "o_tag", "drops": "o_drops"})
    left = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("d")).withColumn("tag", F.xxhash64("d.text"))
    joined = left.join(own, F.col("d.doc_id").eqNullSafe(F.col("o_doc")) & (F.col("tag") == F.col("o_tag")), "left")
    return joined.select(F.struct(F.col("d.doc_id").alias("doc_id"), F.col("d.text").alias("text"), F.col("o_drops").alias("drops")).alias("in"), *(F.col(f"d.`{c}`").alias(f"c_{i}") for i, c in enumerate(names)))


def digests(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text."""
    out = dedup_lines(docs.select("doc_id", "text"), min_docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
