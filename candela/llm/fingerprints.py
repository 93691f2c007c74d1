"""Operator 1: winnowing fingerprints of documents, in DataFrame functions only.

A text's tokens are its words (runs without ``[\\x20\\x09-\\x0D]``). Letters of scripts written without spaces are
tokens of their own, and a run of other letters of more than 24 characters is cut after vowels and odd digits, so that a character
more or less in front moves no cut further on (a stretch of 24 without one is cut by length). Every k consecutive tokens are hashed,
anew for each position as column functions have no rolling state; of every w consecutive hashes the smallest is
chosen, the rightmost one among equals, with its position. Two texts that share a run of k + w - 1 tokens share a fingerprint.

Defined cases: null and empty texts have no tokens, an empty fingerprint, and likeness 1 to
each other, 0 to others. With fewer than k tokens the whole sequence is one gram; with fewer
than w grams all of them are one window. Rows with equal ``doc_id`` are each processed; their
order among themselves is that of their texts' hashes. Extra columns pass through
``with_fingerprint`` and are ignored by ``edited_fingerprints``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .runtime import partitions

GRAM, WINDOW = 4, 8
ALONE = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u312F\u3190-\uA4CF\uF900-\uFAFF"
_IN = rf"[^\x20\x09-\x0D{ALONE}]"
TOKEN = rf"[{ALONE}]|{_IN}{{1,24}}(?!{_IN})|{_IN}{{0,23}}?[aeiou13579]|{_IN}{{1,24}}"
#: Bits of a position below the hash: texts of up to 2^26 tokens keep apart positions.
PLACE = 26


def selected(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """array<long> of chosen grams: 37 bits of hash above 26 bits that fall as the position rises,
    so that the smallest value of a window is its smallest hash and, among equals, the rightmost."""
    def from_tokens(tokens: Column) -> Column:
        def packed(i: Column) -> Column:
            low = F.greatest(F.lit((1 << PLACE) - 1) - i.cast("long"), F.lit(0))
            return F.shiftleft(F.shiftrightunsigned(F.xxhash64(*[F.get(tokens, i + j) for j in range(gram)]), PLACE + 1), PLACE).bitwiseOR(low)

        # past the end F.get gives null, which xxhash64 skips and least ignores
        starts = lambda n, size: F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))
        chosen = F.transform(F.array(F.transform(starts(F.size(tokens), gram), packed)), lambda g: F.array_distinct(
            F.transform(starts(F.size(g), window), lambda i: F.least(*[F.get(g, i + j) for j in range(window)]))))
        return F.when(F.size(tokens) == 0, F.array().cast("array<bigint>")).otherwise(chosen[0])

    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(F.array(tokens), from_tokens)[0]


def hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, PLACE)))


def rendered(chosen: Column) -> Column:
    """hash@position of each chosen gram (positions count tokens from 0), in text order."""
    one = lambda x: F.concat(F.hex(F.shiftright(x, PLACE)), F.lit("@"), F.lit((1 << PLACE) - 1) - x.bitwiseAND(F.lit((1 << PLACE) - 1)))
    return F.array_join(F.transform(chosen, one), " ")


def likeness(a: Column, b: Column, both: Column) -> Column:
    """Jaccard similarity of two sets of hashes with ``both`` in common; 1 if both are empty."""
    whole = F.size(a) + F.size(b) - both
    return F.when(whole == 0, F.lit(1.0)).otherwise(both / F.greatest(whole, F.lit(1)))


def with_fingerprint(docs: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """The rows with one more column, the text's fingerprint."""
    return docs.withColumn(to, rendered(selected(F.col(text))))


def next_texts(docs: DataFrame) -> tuple[DataFrame, WindowSpec]:
    """(doc_id, text, next_text, last): each row with the text that follows in descending ``doc_id``.

    Ids are cut into ranges at approximate quantiles, a few to each shuffle partition, so the
    ordering window never holds more than one range. The first row of each range is also sent to
    the range before it, as a ghost that only lends its text. The last row gets the first one's.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = min(4 * partitions(spark), 20_000)
    cuts = base.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    # A binary search in the sorted cuts: how many of them are below the id.
    if cuts:
        found = F.aggregate(
            F.sequence(F.lit(1), F.lit(len(cuts).bit_length())),
            F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")),
            lambda s, _: F.transform(F.array(F.floor((s.lo + s.hi) / 2).cast("int")), lambda m: F.when(
                s.lo >= s.hi, F.struct(s.lo.alias("lo"), s.hi.alias("hi"))).when(
                F.try_element_at(F.col("_cuts"), m + 1) < F.col("doc_id"), F.struct((m + 1).alias("lo"), s.hi.alias("hi"))).otherwise(
                F.struct(s.lo.alias("lo"), m.alias("hi"))))[0],
            lambda s: s.lo,
        )
        # descending order: the highest ids are in range 1; null ids come last
        rank = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 2)).otherwise(F.lit(len(cuts) + 1) - found)
        ranged = base.withColumn("_cuts", F.array(*[F.lit(c) for c in cuts])).withColumn("r", rank).drop("_cuts")
    else:
        ranged = base.withColumn("r", F.lit(1))
    ranged = ranged.withColumn("tie", F.xxhash64("text"))
    # One small row for each range; at most n + 1 of them.
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    tops = ranged.groupBy("r").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.bitwise_not("tie").alias("t"), "doc_id", "tie")).alias("m")).select("r", "m.doc_id", "m.tie")
    heads = tops.select("r", "doc_id", "tie", F.coalesce(F.lag("r").over(Window.orderBy("r")), F.max("r").over(Window.partitionBy())).alias("to"))
    ghosts = (
        ranged.join(F.broadcast(heads.withColumnsRenamed({"r": "hr", "doc_id": "hd", "tie": "ht"})), (F.col("r") == F.col("hr")) & F.col("doc_id").eqNullSafe(F.col("hd")) & (F.col("tie") == F.col("ht")))
        .select("doc_id", "text", F.col("to").alias("r"), "tie", F.lit(True).alias("ghost"))
        .dropDuplicates(["r", "doc_id", "tie"])
    )
    w = Window.partitionBy("r").orderBy("ghost", *order)
    both = ranged.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    return both.select("r", "ghost", "doc_id", "tie", "text", F.lead("text").over(w).alias("next_text")), w


def edited_fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """For each row its fingerprint and that of its edited text (second half replaced by the start
    of the next document in descending ``doc_id``), with their likeness and that to the next one."""
    rows, w = next_texts(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("f", selected(F.col("text"), gram, window))
    rows = rows.withColumn("next_h", F.coalesce(hashes(F.lead("f").over(w)), hashes(F.col("f")))).where(~F.col("ghost"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", "text"), F.lit(1), half)))
    rows = rows.withColumn("e", selected(F.col("edited"), gram, window)).withColumn("h", hashes(F.col("f"))).withColumn("eh", hashes(F.col("e")))
    rows = rows.withColumn("with_edited", F.size(F.array_intersect("h", "eh"))).withColumn("with_next", F.size(F.array_intersect("h", "next_h")))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        rendered(F.col("f")).alias("fingerprint"),
        rendered(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("eh"), F.col("with_edited")).alias("near_edited"),
        likeness(F.col("h"), F.col("next_h"), F.col("with_next")).alias("near_next"),
    )
