"""Operator 13: target-distribution importance resampling on hashed n-grams.

A batch's texts are joined by separators that no word can hold and one pass of a regular expression finds all words; a
binary search in the documents' offsets gives each word's document, which masks the n-grams that would cross two
documents before their buckets are counted. The CRC of an n-gram continues the CRC of its first n-1 words, so no n-gram is
ever built as a string.

Two passes over the rows: bucket counts of both corpora (at most ``buckets`` numbers from each task, and on the driver),
then each document's mean gain. Gumbel noise from a seeded hash of the id turns the draw without replacement into the
highest scores; ranks come from a range-partitioned sort, with one count from each partition, so no task sorts all rows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased. Defined cases: null or empty text has no words, no
features and weight 0; a text of any length is read in blocks, each led by the last n-1 words before it; rows of equal id
and text tie, and take ranks next to each other; a null id has null noise, hence a null score, and is never drawn;
an empty table gives no rows, an empty target corpus counts as all zeros; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import text_bytes
from .runtime import partitions, stored

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BUCKETS, SIZES, SEED, PERCENT, LEAST_WORDS = 10_000, 2, 7, 25, 20
SENTINEL, LIMIT = b"\x00", 1 << 20


def runs(texts: list[bytes], limit: int = LIMIT, carry: int = SIZES - 1) -> Iterator[tuple[int, list[bytes], int]]:
    """(first text, texts, words carried): runs of texts of about ``limit`` bytes. A longer text comes in blocks that end
    between words; each block after its first is led by the last ``carry`` words of those before it."""
    lo, held = 0, 0
    for k, text in enumerate(texts):
        if len(text) > limit:
            if lo < k:
                yield lo, texts[lo:k], 0
            at, led = 0, []
            while at < len(text):
                end = min(len(text), at + limit)
                while end < len(text) and WORD.match(text[end : end + 1]):  # on to the word's end
                    end += 1
                yield k, [b" ".join([*led, text[at:end]])], len(led)
                led = (led + WORD.findall(text[at:end].lower()))[-carry:] if carry else []
                at = end
            lo, held = k + 1, 0
        elif held + len(text) > limit:
            yield lo, texts[lo:k], 0
            lo, held = k, len(text)
        else:
            held += len(text)
    if lo < len(texts):
        yield lo, texts[lo:], 0


def features(texts: list[bytes], carried: int = 0, sizes: int = SIZES, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and bucket of every n-gram of 1 to ``sizes`` words, and the document of every word. ``carried`` words at
    the start belong to an earlier block: only n-grams that end after them count."""
    joined = SENTINEL.join(texts).lower()
    matches = list(WORD.finditer(joined))
    words = [m.group() for m in matches]
    starts = np.array([m.start() for m in matches], np.int64)
    offsets = np.cumsum([0, *(len(t) + len(SENTINEL) for t in texts[:-1])])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    led = [b" " + w for w in words]
    crc, docs, found = list(map(zlib.crc32, words)), [], []
    for n in range(1, sizes + 1):
        if n > 1:
            crc = list(map(zlib.crc32, led[n - 1 :], crc))
        first = doc[: len(crc)]
        inside = (first == doc[n - 1 :]) & (np.arange(len(crc)) + n > carried)
        docs.append(first[inside])
        found.append(np.array(crc, np.int64)[inside] % buckets)
    return np.concatenate(docs), np.concatenate(found), doc[carried:]


def bucket_counts(texts: DataFrame, sizes: int = SIZES, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, own, carried in runs(text_bytes(batch.column("text")), carry=sizes - 1):
                total += np.bincount(features(own, carried, sizes, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    whole_s, whole_t, b = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (whole_s + b) / ((s + 1) * (whole_t + b)))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, sizes: int = SIZES) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean gain of the features, 0 without any)."""
    held, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value.astype(float)
        for batch in batches:
            size = batch.num_rows
            n_words, n_features, total = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
            for first, own, carried in runs(text_bytes(batch.column("text")), carry=sizes - 1):
                doc, bucket, word = features(own, carried, sizes, buckets)
                at = slice(first, first + len(own))
                n_words[at] += np.bincount(word, minlength=len(own))
                n_features[at] += np.bincount(doc, minlength=len(own))
                total[at] += np.bincount(doc, gain[bucket], minlength=len(own)).astype(np.int64)  # whole numbers below 2^53
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (n_words, n_features, total // np.maximum(n_features, 1)))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with score: weight plus Gumbel noise from a seeded hash of the id, in whole thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    return docs.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows, with ``rank`` (1, 2, 3 ... for the highest scores of rows with enough words; null for others)."""
    spark = scored.sparkSession
    scored = stored(scored.withColumn("_row", F.monotonically_increasing_id()))
    may = scored.where((F.col("n_words") >= least_words) & F.col("score").isNotNull())
    # equal rows are told apart by their row number, so that they may lie in several ranges
    order = [F.desc("score"), F.asc("doc_id"), F.asc("_row")]
    inside = stored(may.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part, bits = F.shiftright("_place", 33), (1 << 33) - 1
    sizes = {r["p"]: r["n"] for r in inside.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row for each partition
    take, before, at = percent * sum(sizes.values()) // 100, {}, 0
    for p in sorted(sizes):
        before[p], at = at, at + sizes[p]
    if before:
        start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), part)
        inside = inside.withColumn("rank", start + F.col("_place").bitwiseAND(F.lit(bits)) + 1)
    else:
        inside = inside.withColumn("rank", F.lit(None).cast("long"))
    inside = inside.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    rest = scored.where((F.col("n_words") < least_words) | F.col("score").isNull()).withColumn("rank", F.lit(None).cast("long"))
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    return inside.select(*cols).unionByName(rest.select(*cols))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, sizes: int = SIZES, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document, drawn towards the texts of ``target``."""
    gain = gains(bucket_counts(docs, sizes, buckets), bucket_counts(target, sizes, buckets))
    return drawn(noise(weights(docs, gain, sizes), seed), percent)
