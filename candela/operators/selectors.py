"""Selection on past results: day-block intervals, trade reports, a rolling selector, promotion and backtest gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.scalars import wilson
from candela.operators import folds
from candela.operators.models import bonferroni_z, expected_calibration_error
from candela.operators.summaries import HASH, block_means_ci  # noqa: F401
from candela.sources.files import kept

DAY = 86_400_000


def trade_report(trades: DataFrame, keys: tuple[str, ...], cost: float, gross: str = "gross_bps", t: str = "event_ms", reason: str = "reason") -> DataFrame:
    """By key at a cost: n, symbols, days, wins, win share, mean and median net, profit factor (null without losses), the daily block
    interval of the mean (null below five days), and the exit reasons with their counts, as ``NAME:n`` in order of names."""
    r = trades.where(F.col(gross).isNotNull()).withColumns({"_net": F.col(gross) - cost, "_day": F.floor(F.col(t) / DAY)})
    net = F.col("_net")
    g = r.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("_day").alias("days"), F.count_if(net > 0).alias("wins"), F.avg((net > 0).cast("double")).alias("win_share"), F.avg(net).alias("mean_net"), F.percentile(net, 0.5).alias("median_net"),
                             (F.coalesce(F.sum(F.when(net > 0, net)), F.lit(0.0)) / -F.sum(F.when(net < 0, net))).alias("profit_factor"))
    names = r.groupBy(*keys, reason).agg(F.count("*").alias("_c")).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.coalesce(reason, F.lit("none")), F.col("_c").cast("string")))), ",").alias("reasons"))
    return g.join(names, list(keys)).join(block_means_ci(r, keys, F.col("_day"), net).drop("blocks"), list(keys))


def rolling_selection(trades: DataFrame, train_days: int = 28, test_days: int = 7, places: int = 3, cost: float = 30.0, least: int = 50, least_days: int = 10, edge: float = 20.0, bound: int = folds.BOUND) -> DataFrame:
    """For each week the variant to trade, null if none is eligible: week, variant, n, days, mean_net, low.

    Trades: id, variant, symbol, signal_ms, entry_ms, exit_ms, gross. A variant is judged on the four weeks before: first the portfolio of
    ``places`` (one trade a symbol, a place is free only after an exit) decides which trades are made, then those not
    settled at the week's begin go: an open trade held its place, though its result is not known. Enough trades and days, a mean above
    ``edge`` after ``cost``, and a daily block interval above zero make it eligible; the highest lower bound wins, then mean, then name.
    """
    week = F.floor(F.col("signal_ms") / (test_days * DAY)).cast("long")
    r = trades.withColumn("_w", week)
    past = r.withColumn("week", F.explode(F.sequence(F.col("_w") + 1, F.col("_w") + train_days // test_days)))
    keys = ("week", "variant")
    made = folds.capacity(past, keys, "id", "entry_ms", "exit_ms", [F.col("entry_ms"), F.col("symbol"), F.col("id")], places, closed=True, bound=bound)
    settled = kept(past.join(made, [*keys, "id"], "left_semi").where(F.col("exit_ms") < F.col("week") * test_days * DAY), "settled")
    net, day = F.col("gross") - cost, F.floor(F.col("signal_ms") / DAY)
    g = settled.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(day).alias("days"), F.avg(net).alias("mean_net")).join(block_means_ci(settled, keys, day, net).select(*keys, "low"), list(keys))
    good = g.where((F.col("n") >= least) & (F.col("days") >= least_days) & (F.col("mean_net") > edge) & (F.col("low") > 0))
    first = good.withColumn("_r", F.row_number().over(Window.partitionBy("week").orderBy(F.desc("low"), F.desc("mean_net"), "variant"))).where("_r = 1").drop("_r")  # one row for each variant
    return r.select(F.col("_w").alias("week")).distinct().join(first, "week", "left").select("week", "variant", "n", "days", "mean_net", "low")


def selected_trades(trades: DataFrame, chosen: DataFrame, test_days: int = 7, places: int = 3, bound: int = folds.BOUND) -> DataFrame:
    """The trades that the chosen variants make week after week in one portfolio, which carries its open places from week to week."""
    r = trades.withColumn("week", F.floor(F.col("signal_ms") / (test_days * DAY)).cast("long")).join(chosen.select("week", "variant"), ["week", "variant"]).withColumn("portfolio", F.lit(1))
    made = folds.capacity(r, ("portfolio",), "id", "entry_ms", "exit_ms", [F.col("week"), F.col("entry_ms"), F.col("symbol"), F.col("id")], places, closed=True, slot=F.col("week"), bound=bound)
    return r.join(made, ["portfolio", "id"], "left_semi").drop("portfolio")


def promotion_gates(trades: DataFrame, keys: tuple[str, ...], costs: tuple[float, float] = (30.0, 50.0), least: int = 100, least_days: int = 15, least_symbols: int = 2) -> DataFrame:
    """By key: a mean above zero at both costs, a daily block interval above zero at the first, and enough trades, signal days and symbols;
    ``passed`` if all hold. Trades: symbol, signal_ms, gross."""
    day = F.floor(F.col("signal_ms") / DAY)
    g = trades.groupBy(*keys).agg(F.count("*").alias("trades"), F.count_distinct(day).alias("days"), F.count_distinct("symbol").alias("symbols"), F.avg(F.col("gross") - costs[0]).alias("mean_first"), F.avg(F.col("gross") - costs[1]).alias("mean_second"))
    g = g.join(block_means_ci(trades, keys, day, F.col("gross") - costs[0]).select(*keys, "low", "high"), list(keys))
    gates = {"gate_first": F.col("mean_first") > 0, "gate_second": F.col("mean_second") > 0, "gate_interval": F.coalesce(F.col("low") > 0, F.lit(False)), "gate_trades": F.col("trades") >= least, "gate_days": F.col("days") >= least_days, "gate_symbols": F.col("symbols") >= least_symbols}
    g = g.withColumns(gates)
    return g.withColumn("passed", F.forall(F.array(*gates), lambda x: x))


def backtest_gate(rows: DataFrame, keys: tuple[str, ...], threshold: float = 0.6, models: int = 6, least: int = 100, accuracy: float = 0.53, most_ece: float = 0.05, edge: float = 0.0, least_blocks: int = 12) -> DataFrame:
    """A backtest's measures by key and the ordered reasons that speak against it.

    Rows: p (probability), base_p (the training rows' rate), target, long_net, short_net, cost, block, touch. All rows give accuracy, Brier score
    and calibration error beside the base rate's; rows as sure as ``threshold`` are the signals, which give hits with Wilson bounds (also at the level shared by
    ``models`` models), gross and net edge, its block interval, mean win and loss, and how many barriers were met or met at once.
    Of the money reasons only the first that holds is given.
    """
    rows = kept(rows, "backtest")
    up = F.col("p") >= 0.5
    whole = expected_calibration_error(rows, "p", "target", *keys).drop("base_brier")
    base = rows.groupBy(*keys).agg(F.avg(F.pow(F.col("base_p") - F.col("target"), 2)).alias("base_brier"), F.avg(((F.col("base_p") >= 0.5) == (F.col("target") == 1)).cast("double")).alias("base_accuracy"))
    s = rows.where((F.col("p") >= threshold) | (F.col("p") <= 1 - threshold)).withColumns({"_net": F.when(up, F.col("long_net")).otherwise(F.col("short_net")), "_ok": (up == (F.col("target") == 1)).cast("int")})
    gross = F.col("_net") + F.col("cost")
    g = s.groupBy(*keys).agg(F.count("*").alias("signals"), F.sum("_ok").alias("hits"), F.avg(gross).alias("gross_edge"), F.avg("_net").alias("net_edge"), F.avg(F.when(gross > 0, gross)).alias("mean_win"), F.avg(F.when(gross <= 0, gross)).alias("mean_loss"),
                             F.avg(F.col("touch").isin("UP", "DOWN", "BOTH").cast("double")).alias("resolved"), F.avg((F.col("touch") == "BOTH").cast("double")).alias("ambiguous"))
    g = g.join(block_means_ci(s, keys, F.col("block"), F.col("_net"), least=1).withColumnsRenamed({"low": "net_low", "high": "net_high"}), list(keys))
    g = whole.join(base, list(keys)).join(g, list(keys), "left").fillna({"signals": 0, "hits": 0, "blocks": 0})
    low, high = wilson(F.col("hits"), F.col("signals"))
    family, _ = wilson(F.col("hits"), F.col("signals"), bonferroni_z(models))
    share = F.coalesce(F.col("hits") / F.nullif("signals", F.lit(0)), F.lit(0.0))
    money = F.when(F.coalesce("net_edge", F.lit(0.0)) <= edge, "edge").when(F.col("blocks") < least_blocks, "blocks").when(F.col("net_low") <= edge, "interval")
    reasons = F.array_compact(F.array(F.when(F.col("signals") < least, "signals"), F.when(share < accuracy, "accuracy"), F.when(F.coalesce(family, F.lit(0.0)) <= 0.5, "family"), F.when(F.col("brier") >= F.col("base_brier"), "brier"), F.when(F.col("ece") > most_ece, "calibration"), money))
    return g.withColumns({"signal_accuracy": share, "low": low, "high": high, "family_low": family, "reasons": F.array_join(reasons, ","), "passed": F.size(reasons) == 0})
