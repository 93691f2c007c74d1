"""Aggregates over settled events: trade summaries, rates, drawdown, bootstrap, selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.scalars import wilson
from candela.operators import folds

DAY = 86_400_000
#: Fixed values of the resampling hash: x = (a r + b s + c) mod p, all products below 2^63.
HASH = (1_000_003, 7_919, 104_729, 2_147_483_647)


def trade_summary(trades: DataFrame, *keys: str) -> DataFrame:
    """Counts, win share, mean and median net, profit factor (null without losses)."""
    n = F.col("net_bps")
    win, loss = F.sum(F.when(n > 0, n)), F.sum(F.when(n <= 0, n))
    return trades.where(n.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("trades"), F.count_distinct("symbol").alias("symbols"), F.count_distinct(F.floor(F.col("event_ms") / DAY)).alias("days"),
        F.count_if(n > 0).alias("wins"), F.round(F.avg((n > 0).cast("double")) * 100, 6).alias("win_pct"), F.round(F.avg(n), 6).alias("mean_net"),
        F.round(F.percentile(n, 0.5), 6).alias("median_net"), F.round(F.coalesce(win, F.lit(0.0)) / F.nullif(-F.coalesce(loss, F.lit(0.0)), F.lit(0.0)), 6).alias("profit_factor"))


def exit_reasons(trades: DataFrame, *keys: str) -> DataFrame:
    """``reasons`` of each key: a map from exit reason to its number of trades, unsettled ones included."""
    counts = trades.groupBy(*keys, "reason").agg(F.count("*").alias("_n"))
    return counts.where("reason is not null").groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "_n")))).alias("reasons"))  # a few reasons each


def trade_report(trades: DataFrame, keys: tuple[str, ...] = ("symbol",), draws: int = 200, seed: int = 7, least: int = 5) -> DataFrame:
    """``trade_summary`` with the exit reasons and the interval of the mean net by resampling days (null with fewer than ``least``).
    Keys without a settled trade have no row. The trades are read three times: give stored ones."""
    ci = block_means_ci(trades, keys, F.floor(F.col("event_ms") / DAY), F.col("net_bps"), draws, seed, least)
    return trade_summary(trades, *keys).join(exit_reasons(trades, *keys), list(keys), "left").join(ci.drop("blocks"), list(keys), "left")


def scorecard(trades: DataFrame) -> DataFrame:
    """Overall, by symbol, by reason and by both, in one pass."""
    return trades.where("net_bps is not null").cube("symbol", "reason").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("trades"), F.count_if(F.col("net_bps") > 0).alias("wins"), F.round(F.sum("net_bps"), 4).alias("total_net"))


def rolling_rates(trades: DataFrame, sizes: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    """Hit rates of each symbol's newest trades with their Wilson bounds."""
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("event_ms")))
    r = trades.where("net_bps is not null").withColumn("r", newest).withColumn("hit", (F.col("net_bps") > 0).cast("int"))
    r = r.withColumn("last", F.explode(F.array(*[F.lit(k) for k in sizes]))).where("r <= last")
    g = r.groupBy("symbol", "last").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return g.withColumn("rate", F.round(F.col("hits") / F.col("n"), 9)).withColumn("low", F.round(low, 9)).withColumn("high", F.round(high, 9))


def drawdown(trades: DataFrame) -> DataFrame:
    """Deepest fall of each symbol's cumulative net below its running peak."""
    w = Window.partitionBy("symbol").orderBy("event_ms").rowsBetween(Window.unboundedPreceding, 0)
    r = trades.where("net_bps is not null").withColumn("c", F.sum("net_bps").over(w)).withColumn("peak", F.max("c").over(w))
    return r.groupBy("symbol").agg(F.round(F.min(F.col("c") - F.col("peak")), 4).alias("max_drawdown"), F.round(F.max("c"), 4).alias("best"))


def cohort_summary(trades: DataFrame, now_ms: int, horizon_ms: int) -> DataFrame:
    """Maturity-aware counts: a rate only where every mature record is resolved."""
    mature = F.col("event_ms") + horizon_ms <= now_ms
    known, hit = F.col("net_bps").isNotNull(), F.col("net_bps") > 0
    g = trades.groupBy("symbol").agg(
        F.count("*").alias("records"), F.count_if(mature).alias("matured"), F.count_if(mature & known).alias("resolved"), F.count_if(~mature).alias("open"),
        F.count_if(mature & ~known).alias("missing"), F.count_if(~mature & known & hit).alias("early_hits"), F.count_if(mature & known & hit).alias("hits"))
    return g.withColumn("hit_rate", F.when((F.col("resolved") > 0) & (F.col("missing") == 0), F.round(F.col("hits") / F.nullif("resolved", F.lit(0)), 9)))


def block_means_ci(rows: DataFrame, keys: tuple[str, ...], block: Column, value: Column, draws: int = 200, seed: int = 7, least: int = 5) -> DataFrame:
    """``keys``, blocks, low, high: the 95 % interval of the mean of ``value`` by resampling whole blocks; null with fewer than ``least``.

    Rows become one sum and count for each block first. A key's blocks (days of a calendar, say) are then two arrays, and a draw adds
    up as many of them as there are, chosen by an integer hash that any engine can repeat: no draw is shuffled or joined.
    """
    a, b, c, p = HASH
    g = rows.withColumns({"_b": block, "_v": value}).where(F.col("_v").isNotNull()).groupBy(*keys, "_b").agg(F.sum("_v").alias("s"), F.count("*").alias("n"))
    g = g.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_b", "s", "n"))).alias("_x")).withColumn("_m", F.size("_x").cast("long"))

    def mean(draw: Column) -> Column:
        x = lambda slot: F.pmod(F.pmod(draw.cast("long") * a + slot.cast("long") * b + seed * c, F.lit(p)) * 48_271, F.lit(p))
        pick = lambda slot: F.get("_x", F.pmod(x(slot), F.col("_m")).cast("int"))
        sums = F.aggregate(F.sequence(F.lit(0), F.size("_x") - 1), F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n")), lambda t, slot: F.struct((t.s + pick(slot).s).alias("s"), (t.n + pick(slot).n).alias("n")))
        return sums.s / sums.n

    means = g.where(F.col("_m") >= least).select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), mean)).alias("_mean"))
    ci = means.groupBy(*keys).agg(F.percentile("_mean", 0.025).alias("low"), F.percentile("_mean", 0.975).alias("high"))
    return g.select(*keys, F.col("_m").alias("blocks")).join(ci, list(keys), "left")


def block_bootstrap(trades: DataFrame, draws: int = 200, seed: int = 7) -> DataFrame:
    """95 % interval of each symbol's mean net by resampling whole days (``block_means_ci``)."""
    ci = block_means_ci(trades, ("symbol",), F.floor(F.col("event_ms") / DAY), F.col("net_bps"), draws, seed, 1)
    return ci.select("symbol", F.lit(draws).cast("long").alias("draws"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


def non_overlapping(trades: DataFrame, step: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Trades that begin at or after the exit of the last accepted one of the same key (a fold in time order)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_ms", kind="stable")
        free, keep = -1, []
        for start, held in zip(pdf["event_ms"], pdf["held"]):
            ok = start >= free
            keep.append(ok)
            if ok:
                free = start + int(held) * step
        return pdf[keep]

    rows = trades.where("net_bps is not null")
    return rows.groupBy(*keys).applyInPandas(fold, rows.schema)


def daily_capped(rows: DataFrame, cap: int, bound: int = folds.BOUND) -> DataFrame:
    """Rows (arm, id, symbol, t, until, score) accepted in order of time, then score: at most ``cap`` of an arm and UTC day, and one
    open at a time for each symbol. Dense arms are folded in chunks of days (``folds``)."""
    taken = folds.daily_capped(rows, ("arm",), "id", "t", "until", [F.col("t"), F.desc("score"), F.col("symbol"), F.col("id")], cap, DAY, bound)
    return rows.join(taken, ["arm", "id"], "left_semi")


def capacity_limited(trades: DataFrame, step: int, cap: int, bound: int = folds.BOUND) -> DataFrame:
    """At most ``cap`` open trades and one for each symbol, in order of time, then symbol; folded in chunks of days (``folds``).
    A symbol has one trade at a time of entry."""
    rows = trades.where("net_bps is not null").withColumns({"variant": F.lit(cap), "_until": F.col("event_ms") + F.col("held") * F.lit(step).cast("long"), "_id": F.concat_ws("@", "symbol", F.col("event_ms").cast("string"))})
    taken = folds.capacity(rows, ("variant",), "_id", "event_ms", "_until", [F.col("event_ms"), F.col("symbol")], cap, bound=bound)
    return rows.join(taken, ["variant", "_id"], "left_semi").select(*trades.columns, "variant")
