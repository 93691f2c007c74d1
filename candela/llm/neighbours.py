"""Operator 9: a quality classifier by nearest-neighbour voting in a latent-semantic space.

Terms are hashed byte bigrams of the text and shapes of its words (case, marks, length, equal to the
word before). Term weights, the latent directions and the labelled vectors come from at most
``sample`` labelled rows, chosen by a hash of their id: the bound of all that is collected and
broadcast (``sample`` x ``rank`` and ``TERMS`` x ``rank`` floats). Every document is then projected and
compared with every labelled vector, in exact blocked cosine products; the ``k`` nearest vote, weighted
by their similarity to a power.

Defined cases: texts without terms (null, empty, one blank) get the share of label 1 in the sample; so
does everything if there are no usable labels (0.5 with none at all). Repeated rows score alike. Label
rows without a document, or with a null label, are not used; with several labels of an id the largest counts, of
several texts of an id the smallest is learnt from (and each row is scored by its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import pieces, words

TERMS, SHAPES = 4096, 96
SAMPLE, RANK, NEAREST, POWER = 4000, 64, 25, 4
BLOCK = 256


def _bigram_terms() -> np.ndarray:
    x = np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(40)) % np.uint64(TERMS - SHAPES)).astype(np.int64) + SHAPES


_BIGRAM = _bigram_terms()
_UPPER, _MARK, _DIGIT = (np.zeros(256, np.int64) for _ in range(3))
_UPPER[65:91] = 1
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = 1
_DIGIT[48:58] = 1


def counts(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, TERMS) counts of the terms of the texts at ``at`` in ``buf``."""
    n = len(at) - 1
    out = np.zeros(n * TERMS)
    if len(buf):
        owner = np.repeat(np.arange(n), np.diff(at))
        both = owner[1:] == owner[:-1]
        pair = (buf[:-1].astype(np.int64) << 8 | buf[1:])[both]
        out += np.bincount(owner[:-1][both] * TERMS + _BIGRAM[pair], minlength=len(out))
        w = words(buf, at)
        if len(w.start):
            own, size = w.owner(), w.end - w.start
            sums = [np.concatenate([[0], np.cumsum(t[buf])]) for t in (_UPPER, _MARK, _DIGIT)]
            upper, mark, digit = (s[w.end] - s[w.start] for s in sums)
            case = np.where(upper == 0, 0, np.where(upper == 1, 1, 2))
            shape = (case * 4 + np.minimum(mark, 3)) * 2 + (digit > 0)  # 24 shapes
            length = 24 + np.minimum(size, 31)
            last = _MARK[buf[w.end - 1]] * (56 + buf[w.end - 1].astype(np.int64) % 32)  # by last mark
            h = w.hashes()
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
            for term in (shape, length, np.where(last > 0, last, 88), np.where(again, 89, 90)):
                out += np.bincount(own * TERMS + term, minlength=len(out))
    return out.reshape(n, TERMS)


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, end, counts) of at most BLOCK texts each."""
    for lo, hi, buf, at in pieces(column):
        for a in range(0, hi - lo, BLOCK):
            b = min(a + BLOCK, hi - lo)
            yield lo + a, lo + b, counts(buf[at[a] : at[b]], at[a : b + 1] - at[a])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """(text, y) of at most ``sample`` labelled rows outside the held-out fold."""
    usable = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).alias("_y")).where("_y is not null and _id is not null")
    usable = usable.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
    known = docs.select(F.col("doc_id").cast("long").alias("_id")).distinct()
    picked = usable.join(known, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "_id")  # at most ``sample`` ids
    return rows.groupBy("_id").agg(F.min("text").alias("text"), F.min("_y").cast("int").alias("y"))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], rank: int = RANK) -> dict | None:
    """Latent directions and labelled vectors from rows of terms, their counts and a label."""
    if not rows:
        return None
    x = np.zeros((len(rows), TERMS), np.float32)
    for r, (at, n, _) in zip(x, rows):
        r[at] = n
    y = np.array([r[2] for r in rows], np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    x = _weighted(x, idf)
    rng = np.random.default_rng(0)
    q = np.linalg.qr(x.T @ (x @ rng.standard_normal((TERMS, rank + 8)).astype(np.float32)))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    basis = np.ascontiguousarray((q @ vt.T)[:, :rank], np.float32)
    return {"idf": idf, "basis": basis, "vectors": _unit(x @ basis), "y": y}


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    return (v / np.maximum(size, 1e-12)).astype(np.float32)


def _weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Relative frequencies on a logarithmic scale times the terms' weights, of length one."""
    share = x / np.maximum(x.sum(1, keepdims=True), 1)
    return _unit(np.log1p(share * 1000).astype(np.float32) * idf)


def vote(model: dict, x: np.ndarray, k: int = NEAREST, power: int = POWER) -> np.ndarray:
    """The scores of rows of term counts."""
    prior = float(model["y"].mean())
    some = x.sum(1) > 0
    z = _unit(_weighted(x.astype(np.float32), model["idf"]) @ model["basis"])
    sim = z @ model["vectors"].T
    k = min(k, sim.shape[1])
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(sim, near, 1), 0) ** power
    total = w.sum(1)
    score = np.where(total > 0, (w * model["y"][near]).sum(1) / np.maximum(total, 1e-12), prior)
    return np.where(some, np.clip(score, 0, 1), prior).astype(np.float64)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, sample: int = SAMPLE, k: int = NEAREST) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_pylist()
            for lo, hi, x in blocks(batch.column("text")):
                # only the terms that are there travel: their numbers and counts
                at = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(lo, hi - lo), pa.array(y[lo:hi], pa.int32()), pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([r[a].astype("<f4").tobytes() for r, a in zip(x, at)], pa.binary())], names=["_id", "y", "at", "n"])

    rows = training_rows(docs, labels, label, sample).mapInArrow(features, "_id long, y int, at binary, n binary").orderBy("_id").collect()  # at most ``sample``
    model = fit([(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["n"], "<f4"), r["y"]) for r in rows if len(r["at"])])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo, hi, x in blocks(batch.column("text")):
                score = vote(own, x, k) if own else np.full(hi - lo, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(score)], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
