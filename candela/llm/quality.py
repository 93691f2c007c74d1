"""Operator 8: quality rules with tokeniser fertility.

Base counts describe each text; the method tokenises its words with a public vocabulary that falls
back to bytes and measures characters per token, the share of byte tokens and the evenness of the
tokens (their entropy over its largest possible value for the text's token count). Rejection bands
are set for each language and power of two of the word count from the corpus itself: the median over
all texts that pass the base rules, with multiples of the interquartile range on both sides (at
least a floor, so that a uniform corpus is not cut). Small groups share wider ones' bands.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined cases: null or empty text has no words and fails the base
rules; a null language is ``und``; repeated rows are judged alike; with no rows there are no bands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import grams, pieces, text_bytes, words
from .runtime import small, stored
from .tokens import PieceBpe

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
MIN_WORDS, MAX_REPEAT = 50, 50
#: For each measure: interquartile ranges below and above the median that stay (None: no bound), and the
#: least range. Long texts repeat more tokens, so groups are languages by powers of two of the word count.
BANDS = {"chars_per_token": (3.0, 5.0, 0.03), "byte_share": (None, 6.0, 0.02), "evenness": (1.75, None, 0.02)}
GROUP = ("lang", "size_class")


def metrics(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, lang and the measures of each row's text, in the rows' columns order."""
    kind = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("lang", pa.string()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")), *((c, pa.float64()) for c in BANDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceBpe(vocabulary)
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for lo, hi, buf, at in pieces(batch.column("text")):
                w = words(buf, at)
                g = grams(w.hashes(), 3)
                # running counts of code points in words and of symbols
                points = np.zeros(len(buf) + 1, np.int64)
                inside = np.zeros(len(buf) + 1, np.int8)
                inside[w.start] += 1
                inside[w.end] -= 1
                np.cumsum((np.cumsum(inside[:-1]) > 0) & ((buf & 0xC0) != 0x80), out=points[1:])
                marks = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
                texts = text_bytes(batch.column("text").slice(lo, hi - lo))
                for d, text in enumerate(texts):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    ids = model.encode_words(text.split())
                    n = len(ids)
                    chars = int(points[at[d + 1]] - points[at[d]])
                    share = even = fertility = None
                    if n:
                        fertility = chars / n
                        share = float(model.is_byte[ids].mean())
                        count = np.unique(ids, return_counts=True)[1] if n < 30_000 else np.bincount(ids)
                        p = count[count > 0] / n
                        even = float(-(p * np.log2(p)).sum() / np.log2(n)) if n > 1 else 0.0
                    row = (b - a, chars, int(marks[at[d + 1]] - marks[at[d]]), _repeated_lines(text), _repeat_words(g[a : max(a, b - 2)], b - a), n, fertility, share, even)
                    for c, v in zip(out, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), batch.column("lang"), *(pa.array(c, f.type) for c, f in zip(out, list(kind)[3:]))], schema=kind)

    lang = F.coalesce("lang", F.lit("und")) if "lang" in docs.columns else F.lit("und")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), lang.cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, tag long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, evenness double")


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _repeat_words(windows: np.ndarray, n: int) -> int:
    """Words in 3-word windows that occur twice or more in the text."""
    if len(windows) < 2:
        return 0
    _, where, count = np.unique(windows, return_inverse=True, return_counts=True)
    hit = count[where] > 1
    cover = np.zeros(n, bool)
    for j in range(3):
        cover[j : j + len(hit)] |= hit
    return int(cover.sum())


def bands(measured: DataFrame, min_group: int = 100) -> DataFrame:
    """lang, size_class, and low and high bounds of each measure. Groups of fewer than ``min_group`` texts take
    the bounds of their size class over all languages, and small size classes those of the whole corpus."""
    ok = measured.where("not base_failed")

    def quartiles(*keys: str, to: str) -> DataFrame:
        return ok.groupBy(*keys).agg(F.count("*").alias(f"n_{to}"), *[F.percentile_approx(c, [0.25, 0.5, 0.75], 2000).alias(f"{to}_{c}") for c in BANDS])

    groups = measured.select(*GROUP).distinct()
    both = groups.join(quartiles(*GROUP, to="g"), list(GROUP), "left").join(quartiles("size_class", to="s"), "size_class", "left").join(F.broadcast(quartiles(to="w")))  # one row
    bounds = []
    for c, (below, above, least) in BANDS.items():
        q = F.when(F.col("n_g") >= min_group, F.col(f"g_{c}")).when(F.col("n_s") >= min_group, F.col(f"s_{c}")).otherwise(F.col(f"w_{c}"))
        spread = F.greatest(q[2] - q[0], F.lit(least))
        bounds += [(q[1] - below * spread if below else F.lit(float("-inf"))).alias(f"{c}_low"), (q[1] + above * spread if above else F.lit(float("inf"))).alias(f"{c}_high")]
    return both.select(*GROUP, *bounds)


def judged(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """The measures with ``base_failed``, ``kept`` and ``reason`` (the first band left, if any)."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    size = F.least(F.floor(F.log2(F.greatest("n_words", F.lit(1)).cast("double"))), F.lit(14)).cast("int")
    measured = stored(metrics(docs, vocabulary).withColumn("base_failed", failed).withColumn("size_class", size))
    joined = measured.join(small(stored(bands(measured))), list(GROUP), "left")
    reason = F.when(F.col("base_failed"), F.lit("base"))
    for c in BANDS:
        reason = reason.when(~F.coalesce(F.col(c).between(F.col(f"{c}_low"), F.col(f"{c}_high")), F.lit(True)), F.lit(c))
    return joined.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())


def verdicts(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "byte_share", "evenness", "reason")


def kept_only(docs: DataFrame) -> DataFrame:
    """The rows whose text is kept; columns as they are. Rows are matched by id and text."""
    good = judged(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    good = small(stored(good))
    return docs.join(good, docs.doc_id.cast("long").eqNullSafe(good._id) & (F.xxhash64(docs.text) == good._tag), "left_semi")
