"""Operator 10: mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree domain - language - source. At each node it is shared among the
children by weight; a child that cannot use its share (its texts times the epochs allowed hold fewer
tokens) takes all it has and the rest is shared again among its siblings. What all siblings together
cannot use was never given to them: the parent's own limit is the sum of its children's, so a
shortage is made up among siblings first and by ancestors' siblings only then. Each leaf takes whole
epochs of its texts, then the longest prefix of a seeded order of the next epoch that fits.

Leaves are a configured list (their table is small: one row for each domain, language and source);
their budgets are set on the driver. Prefixes are found in two levels: sums over hash ranges of a
leaf, then single rows in the one range where the prefix ends, so no task sorts a whole leaf.

Domains are configured (``DOMAINS``). Tokens are words ``[^\\x20\\x09-\\x0D]+``. Defined cases: null or empty text has no tokens and is taken
if the prefix reaches it; null language or source is a leaf of its own (``und``, ``none``); equal rows
have equal places in the order and enter together; children without a weight get ``default``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import small, stored

#: The production mix: which domain a source belongs to, and the target weights. Sources that are not listed are "other".
DOMAINS = {f"src{i}": d for d, own in {"web": range(0, 8), "news": range(8, 12), "books": range(12, 16), "forums": range(16, 20)}.items() for i in own}
LANGUAGE_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}
DOMAIN_WEIGHTS = {"web": 4.0, "news": 3.0, "books": 2.0, "forums": 1.0, "other": 1.0}
SHARE, EPOCHS, SEED, RANGE_ROWS = 0.8, 2, "mix-1", 4096


def domain_of(source: Column, domains: dict[str, str] | None = None) -> Column:
    """The source's configured domain."""
    pairs = [F.lit(x) for kv in (DOMAINS if domains is None else domains).items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), source), F.lit("other")) if pairs else F.lit("other")


def share_out(amount: float, children: list[tuple[str, float, float]]) -> dict[str, float]:
    """Amount shared among (name, weight, limit) by weight, none above its limit."""
    given, left = {}, sorted(children)
    amount = min(amount, sum(c[2] for c in left))
    while left:
        total = sum(w for _, w, _ in left)
        part = {n: amount * w / total if total else amount / len(left) for n, w, _ in left}
        full = [(n, lim) for n, _, lim in left if part[n] >= lim]
        if not full:
            return given | part
        for n, lim in full:
            given[n] = lim
            amount -= lim
        left = [c for c in left if c[0] not in given]
    return given


def budgets(leaves: list[tuple[tuple[str, str, str], int]], budget: float, epochs: int, weight: Callable[[tuple], float]) -> dict[tuple, int]:
    """Tokens for each leaf. ``weight`` is asked for a path prefix of one, two or three names."""
    def descend(prefix: tuple, own: list[tuple[tuple, int]], amount: float) -> dict[tuple, int]:
        if len(prefix) == 3:
            return {prefix: int(amount)}
        below: dict[str, list] = {}
        for path, tokens in own:
            below.setdefault(path[len(prefix)], []).append((path, tokens))
        shares = share_out(amount, [(n, weight((*prefix, n)), float(epochs * sum(t for _, t in rows))) for n, rows in below.items()])
        out: dict[tuple, int] = {}
        for n, rows in below.items():
            out |= descend((*prefix, n), rows, shares[n])
        return out

    return descend((), leaves, budget)


def default_weight(path: tuple) -> float:
    return (DOMAIN_WEIGHTS if len(path) == 1 else LANGUAGE_WEIGHTS if len(path) == 2 else {}).get(path[-1], 1.0)


def mixed(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, weight: Callable[[tuple], float] = default_weight) -> DataFrame:
    """The chosen rows, once for each epoch that takes them: ``row`` (a struct of the input's columns as f0, f1 ...),
    ``_leaf`` (a struct), ``_tokens``, ``_epoch``. The budget is ``share`` of all tokens.
    """
    spark = docs.sparkSession
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    source = F.coalesce(F.col("source").cast("string"), F.lit("none"))
    row = F.struct(*(docs[f"`{c}`"].alias(f"f{i}") for i, c in enumerate(docs.columns))).alias("row")
    keyed = docs.select(row, "doc_id", "text", "lang", "source").withColumns({
        "_leaf": F.struct(domain_of(source).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), source.alias("source")),
        "_tokens": F.size(words).cast("long"),
    })
    place = lambda epoch: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), epoch, F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))), 1, 13), 16, 10).cast("long")
    # narrow rows first: the texts are read once more at the end instead of being shuffled
    narrow = stored(keyed.select("doc_id", F.xxhash64("text").alias("_tag"), "_leaf", "_tokens", *[place(F.lit(str(e))).alias(f"_p{e}") for e in range(epochs)]))
    leaf_rows = narrow.groupBy("_leaf").agg(F.sum("_tokens").alias("t"), F.count("*").alias("n")).collect()  # the configured tree's leaves
    have = {(r["_leaf"]["domain"], r["_leaf"]["lang"], r["_leaf"]["source"]): (r["t"], r["n"]) for r in leaf_rows}
    total = sum(t for t, _ in have.values())
    given = budgets([(k, t) for k, (t, _) in have.items()], share * total, epochs, weight)
    plan = []
    for path, amount in given.items():
        t, n = have[path]
        whole = min(amount // t, epochs) if t else 0
        plan.append((*path, int(whole), int(amount - whole * t) if whole < epochs else -1, -(-n // RANGE_ROWS)))
    table = spark.createDataFrame(plan, "domain string, lang string, source string, whole int, rest long, ranges long")
    table = F.broadcast(table.select(F.struct("domain", "lang", "source").alias("_leaf"), "whole", "rest", "ranges"))
    rows = narrow.join(table, "_leaf")
    # the partial epoch: position in the seeded order, then the hash range it lies in
    at = F.lit(None).cast("long")
    for e in range(epochs):
        at = F.when(F.col("whole") == e, F.col(f"_p{e}")).otherwise(at)
    rows = rows.withColumn("at", at).withColumn("range", F.floor(F.shiftright("at", 22).cast("double") * F.col("ranges") / 2**30).cast("long"))
    sums = rows.where("at is not null").groupBy("_leaf", "range", "rest").agg(F.sum("_tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy("_leaf").orderBy("range"))
    ends = sums.withColumn("end", upto)
    ends = stored(ends.groupBy("_leaf", "rest").agg(F.min(F.when(F.col("end") > F.col("rest"), F.struct("range", (F.col("end") - F.col("t")).alias("before")))).alias("stop")))
    rows = rows.join(F.broadcast(ends.select("_leaf", F.col("stop.range").alias("stop"), F.col("stop.before").alias("before"))), "_leaf", "left")  # one row for each leaf
    inside = F.col("at").isNotNull() & (F.col("stop").isNull() | (F.col("range") < F.col("stop")))
    cut = rows.where("range = stop")
    running = F.sum("_tokens").over(Window.partitionBy("_leaf").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    cut = cut.withColumn("extra", (F.col("before") + running <= F.col("rest")).cast("int"))
    sure = rows.where("stop is null or range is null or range <> stop").withColumn("extra", F.coalesce(inside.cast("int"), F.lit(0)))
    chosen = sure.unionByName(cut).withColumn("take", F.col("whole") + F.col("extra")).where("take > 0")
    # equal rows (same id and text) all have the same place: one entry stands for them
    chosen = chosen.select(F.col("doc_id").alias("_id"), "_tag", F.col("_leaf").alias("_l"), "take").distinct()
    joined = keyed.withColumn("_t", F.xxhash64("text")).join(
        small(stored(chosen)), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_tag")) & (F.col("_leaf") == F.col("_l")))
    return joined.select("row", "_leaf", "_tokens", F.explode(F.sequence(F.lit(0), F.col("take") - 1)).alias("_epoch"))


def selection(docs: DataFrame) -> DataFrame:
    """The mix as doc_id, leaf, epoch and tokens."""
    out = mixed(docs)
    return out.select(F.col(f"row.f{docs.columns.index('doc_id')}").alias("doc_id"), "_leaf.domain", "_leaf.lang", "_leaf.source", F.col("_epoch").cast("int").alias("epoch"), F.col("_tokens").alias("n_tokens"))


def chosen_docs(docs: DataFrame) -> DataFrame:
    """The chosen rows with the columns they came with; a text taken in two epochs comes twice."""
    return mixed(docs).select(*[F.col(f"row.f{i}").alias(c) for i, c in enumerate(docs.columns)])
