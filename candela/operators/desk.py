"""Desk operators: snapshot filters, event-window checks, freshness, reasons, enrichment, grids, spacing and counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from candela.functions.ewm import ewms
from candela.functions.scalars import frame, guarded, ratio, series, true_range

DAY = 86_400_000


def snapshots(prices: DataFrame, premium: DataFrame, volume: DataFrame) -> DataFrame:
    """Prices (symbol, bid, ask) with mark and funding and 24-hour volume where known. Prices that are not positive or finite, or
    whose ask lies below the bid, go."""
    ok = (F.col("bid") > 0) & (F.col("ask") >= F.col("bid")) & (F.col("ask") < float("inf"))
    r = prices.where(ok).join(premium, "symbol", "left").join(volume, "symbol", "left")
    return r.select("symbol", ((F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2) * 10_000).alias("spread_bps"), "mark", (F.col("funding") * 10_000).alias("funding_bps"), "quote_volume")


def window_status(events: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Events with ``path`` checked: the source candle is there once and closes at the stated price, the window is whole, and every
    candle is positive with its high and low around the others."""
    b = bars.groupBy("symbol", F.col("open_time_ms").alias("event_ms")).agg(F.count("*").alias("n"), F.max("close").alias("seen"))
    r = events.join(b, ["symbol", "event_ms"], "left")
    bad = F.exists("path", lambda x: (x.low <= 0) | (x.high < F.greatest(x.open, x.close)) | (x.low > F.least(x.open, x.close)))
    status = (F.when(F.coalesce("n", F.lit(0)) != 1, "no_source").when(F.abs(F.col("seen") - F.col("source")) > 1e-9, "source_price").when(F.size("path") != horizon, "rows").when(bad, "range").otherwise("ok"))
    return r.select("symbol", "event_ms", status.alias("status"))


def fresh(newest: DataFrame, now_ms: int, max_age_ms: int) -> DataFrame:
    """(symbol, close_ms) of a scan with ``fresh`` and the scan's coverage; ``kept`` marks those of the newest bar."""
    all_ = Window.partitionBy()
    r = newest.withColumn("fresh", (F.lit(now_ms) - F.col("close_ms") <= max_age_ms) & (F.col("close_ms") <= now_ms))
    # one row for each symbol of a scan
    return r.withColumns({"coverage": F.avg(F.col("fresh").cast("double")).over(all_), "kept": F.col("fresh") & (F.col("close_ms") == F.max(F.when(F.col("fresh"), F.col("close_ms"))).over(all_))})


def eligibility(rows: DataFrame, now_ms: int, least_confidence: float = 0.55, max_age_days: int = 8, least_left: float = 0.6) -> DataFrame:
    """Why a scored row may not be sent: its model's gate, confidence, age, and the part of the target candle that is left."""
    left = (F.col("target_close_ms") - now_ms) / F.col("step_ms")
    reasons = F.array_compact(F.array(F.when(~F.col("gate"), "gate"), F.when(F.col("confidence") < least_confidence, "confidence"), F.when(F.lit(now_ms) - F.col("trained_ms") > max_age_days * DAY, "stale"), F.when(left <= 0, "closed").when(left < least_left, "timing")))
    return rows.withColumn("reasons", F.array_join(reasons, ",")).withColumn("eligible", F.size(reasons) == 0)


def oi_changes(oi: DataFrame, step: int, lags: tuple[int, ...], points: int = 13) -> DataFrame:
    """(series, lag, open_time_ms, change): the change over 12 steps known ``lag`` steps before; null unless all points are there."""
    w = Window.partitionBy("series").orderBy("t")
    c = oi.withColumns({"change": ratio(F.col("v"), F.lag("v", points - 1).over(w)) - 1, "n": F.count("*").over(w.rangeBetween(-(points - 1) * step, 0))})
    return c.select("series", F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), "t", F.when(F.col("n") == points, F.col("change")).alias("change")).withColumn("open_time_ms", F.col("t") + F.col("lag") * F.lit(step).cast("long")).drop("t")


def oi_coverage(oi: DataFrame, candles: DataFrame, step: int, lags: tuple[int, ...] = (1, 2, 3), points: int = 13) -> DataFrame:
    """How far open interest (series, t, v) covers the candles (series, close_ms on the grid) if it is known ``lag`` steps late: one row for
    each series and lag.

    Of the series: rows, off_grid (stamps beside the grid), grid_rows, gaps and the largest step between grid rows, invalid (not finite or not positive).
    Of the lag: eligible candles (those that the series could serve), complete ones (every point of the window is on the grid and valid), missing, and days
    with a complete one. Nothing is filled.
    """
    valid = F.coalesce((F.col("v") > 0) & (F.col("v") < float("inf")), F.lit(False))
    on = F.col("t") % step == 0
    w = Window.partitionBy("series").orderBy("t")
    grid = oi.where(on).withColumns({"ok": valid, "d": F.col("t") - F.lag("t").over(w)})
    whole = grid.withColumn("n", F.count_if("ok").over(w.rangeBetween(-(points - 1) * step, 0))).where(F.col("n") == points).select("series", "t", F.lit(True).alias("complete"))
    of_all = oi.groupBy("series").agg(F.count("*").alias("rows"), F.count_if(~on).alias("off_grid"), F.count_if(~valid).alias("invalid"), F.min("t").alias("start_ms"), F.max("t").alias("end_ms"))
    of_grid = grid.groupBy("series").agg(F.count("*").alias("grid_rows"), F.count_if(F.col("d") != step).alias("gaps"), F.max("d").alias("largest_ms"))
    total = of_all.join(of_grid, "series").withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags])))
    late = F.col("lag") * F.lit(step).cast("long")
    asked = candles.select("series", "close_ms").join(total, "series").where(F.col("close_ms").between(F.col("start_ms") + (points - 1) * step + late, F.col("end_ms") + late))
    met = asked.withColumn("t", F.col("close_ms") - late).join(whole, ["series", "t"], "left")
    done = F.coalesce("complete", F.lit(False))
    g = met.groupBy("series", "lag").agg(F.count("*").alias("eligible"), F.count_if(done).alias("complete"), F.count_if(~done).alias("missing"), F.count_distinct(F.when(done, F.floor(F.col("close_ms") / DAY))).alias("days"))
    return total.join(g, ["series", "lag"], "left").fillna(0, ["eligible", "complete", "missing", "days"])


def oi_reason(liquid: Column) -> Column:
    """The first reason against a breakout: context, liquidity, falling benchmarks, open interest."""
    context = F.col("c0").isNotNull() & F.col("c1").isNotNull() & F.col("r0").isNotNull() & F.col("r1").isNotNull()
    confirmed = (F.least("c0", "c1") >= 0) & (F.greatest("c0", "c1") >= 0.005)
    return F.when(~context, "missing_context").when(~F.coalesce(liquid, F.lit(False)), "liquidity").when((F.col("r0") <= 0) | (F.col("r1") <= 0), "not_rising").when(~confirmed, "not_confirmed").otherwise("confirmed")


def stale_tables(newest: DataFrame, limits: dict[str, int], now_ms: int) -> DataFrame:
    """(code, age_ms) of the tables (name, newest_ms) that are older than their limit, or empty."""
    limit = F.coalesce(*[F.when(F.col("name") == k, F.lit(v)) for k, v in limits.items()])
    age = F.lit(now_ms) - F.col("newest_ms")
    return newest.where(F.col("newest_ms").isNull() | (age > limit)).select(F.concat(F.lit("stale:"), "name").alias("code"), age.alias("age_ms"))


def due_incidents(found: DataFrame, sent: DataFrame, now_ms: int, repeat_ms: int) -> DataFrame:
    """Incidents whose last message is older than the repeat time."""
    return found.join(sent, "code", "left").where(F.col("sent_ms").isNull() | (F.lit(now_ms) - F.col("sent_ms") >= repeat_ms)).drop("sent_ms")


def explore(signals: DataFrame, zone: str, **wanted) -> DataFrame:
    """The signal explorer's conjunctive filter; absent conditions do not count."""
    day = F.to_date(F.from_utc_timestamp(F.timestamp_millis("bar_ms"), zone))
    tests = {"audience": lambda v: F.col("notified") == (v == "notified"), "symbol": lambda v: F.upper("symbol").contains(v.upper()), "family": lambda v: F.array_contains("families", v), "direction": lambda v: F.col("direction") == v,
             "regime": lambda v: F.col("regime") == v, "strategy": lambda v: F.col("strategy") == v, "policy": lambda v: F.col("policy") == v, "since": lambda v: day >= F.lit(v).cast("date"), "until": lambda v: day <= F.lit(v).cast("date"), "status": lambda v: F.col("status").isNull() if v == "open" else F.col("status") == v}
    for name, value in wanted.items():
        if value is not None:
            signals = signals.where(tests[name](value))
    return signals


def bracket_grid(events: DataFrame, grid: DataFrame, horizon: int) -> DataFrame:
    """Events with whole paths against every cell (target, stop, hold) of a small grid: one row for each cell, from expressions over the
    same arrays."""
    r = events.where(F.size("path") == horizon).crossJoin(F.broadcast(grid))  # a parameter grid
    entry = F.col("path")[0].open
    within = F.filter("path", lambda x: x.k <= F.col("hold"))
    hit = F.try_element_at(F.filter(within, lambda x: (x.low <= entry * (1 - F.col("stop") / 100)) | (x.high >= entry * (1 + F.col("target") / 100))), F.lit(1))
    r = r.withColumns({"entry": entry, "hit": hit, "last": F.element_at(within, -1)})
    price = F.when(F.col("hit.low") <= F.col("entry") * (1 - F.col("stop") / 100), F.col("entry") * (1 - F.col("stop") / 100)).when(F.col("hit").isNotNull(), F.col("entry") * (1 + F.col("target") / 100)).otherwise(F.col("last.close"))
    net = (price / F.col("entry") - 1) * 10_000
    return r.groupBy("target", "stop", "hold").agg(F.count("*").alias("trades"), F.count_if(net > 0).alias("wins"), F.avg(net).alias("mean_gross"))


def spaced(rows: DataFrame, key: str, t: str, until: str, tie: str | None = None) -> DataFrame:
    """Per key in time order (rows of one time by ``tie``, or by ``until``), the rows that begin at or after the ``until`` of the last
    accepted one. One short series in each group; keys are spread over the cluster."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([t, tie or until], kind="stable")
        free, keep = None, []
        for begin, end in zip(pdf[t], pdf[until]):
            ok = free is None or begin >= free
            keep.append(ok)
            free = end if ok else free
        return pdf[keep]

    return rows.groupBy(key).applyInPandas(fold, rows.schema)


def seeded_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's ATR that starts from the mean of the first n true ranges."""
    w = series()
    r = bars.withColumns({"tr": true_range(w), "_rn": F.row_number().over(w)}).withColumn("_seed", guarded(F.avg, F.col("tr"), frame(w, n), n))
    r = r.withColumn("_x", F.when(F.col("_rn") == n, F.col("_seed")).when(F.col("_rn") > n, F.col("tr")))
    return ewms(r, {"atr": ("_x", 1 / n, 1)}).drop("_rn", "_seed", "_x")


def tick_sizes(rows: DataFrame, price: str) -> DataFrame:
    """The tick of each symbol from the most decimal digits that its price texts use."""
    digits = F.length(F.coalesce(F.get(F.split(price, r"\."), F.lit(1)), F.lit("")))
    return rows.groupBy("symbol").agg(F.max(digits).alias("digits")).withColumn("tick", F.pow(F.lit(10.0), -F.col("digits")))


def gap_free(bars: DataFrame, step: int) -> DataFrame:
    """The candles, or an error at the first break of the grid."""
    d = F.col("open_time_ms") - F.lag("open_time_ms").over(series())
    marked = bars.withColumn("_d", d)
    return marked.where(F.when(F.coalesce(F.col("_d") == step, F.lit(True)), True).otherwise(F.raise_error(F.concat(F.lit("gap in "), "symbol")))).drop("_d")


def strategy_direction(items: DataFrame, forecast: DataFrame, code, horizon_of: dict[str, int]) -> DataFrame:
    """The direction that exactly one playbook supports at its own fixed horizon: the weighted label says so, every family has a
    forecast there and permits it, and at least one asserts it. Items: id, families, regime, allow_short."""
    from candela.operators.ledgers import direction_of, short_net

    f = forecast.withColumn("label", direction_of(F.col("p_up"), F.col("median_gross"), F.col("median_net")))
    sides = items.withColumn("up", F.explode(F.array(F.lit(True), F.lit(False)))).where(F.col("up") | F.col("allow_short"))
    name = code(F.col("up"), F.array_contains("families", "F2"), F.col("regime") == "BULL")
    sides = sides.withColumn("h", F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in horizon_of.items()])).select("id", "up", "h", F.size("families").alias("n_families"))
    j = sides.join(f.drop("symbol", "regime"), "id").where(F.col("h") == F.col("horizon"))
    want = F.when(F.col("up"), "UP").otherwise("DOWN")
    mild = F.when(F.col("up"), (F.col("p_up") >= 0.5) & (F.col("median_net") >= 0)).otherwise((F.col("p_up") <= 0.5) & (short_net(F.col("median_gross"), F.col("median_net")) >= 0))
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    g = j.groupBy("id", "up", "n_families").agg(F.count("*").alias("seen"), F.every((F.col("label") == want) | ((F.col("label") == "MIXED") & mild)).alias("permit"), F.some(F.col("label") == want).alias("assert_"), mean("p_up").alias("p"), mean("median_gross").alias("g"), mean("median_net").alias("t"))
    ok = (F.col("seen") == F.col("n_families")) & F.col("permit") & F.col("assert_") & (direction_of(F.col("p"), F.col("g"), F.col("t")) == want)
    won = g.where(ok).groupBy("id").agg(F.count("*").alias("c"), F.max(want).alias("d"))
    return items.select("id").join(won, "id", "left").select("id", F.when(F.col("c") == 1, F.col("d")).otherwise("MIXED").alias("direction"))


class ExpandLevels:
    """Table function: the target prices of a side at each level in percent, one row for each."""

    LEVELS = (2.0, 3.0, 5.0)

    def eval(self, price: float, side: str):
        if price is not None and side in ("LONG", "SHORT"):
            for level in self.LEVELS:
                yield level, price * (1 + (level if side == "LONG" else -level) / 100)


def register_levels(spark) -> str:
    """Registers ``expand_levels(price, side)`` for lateral joins in SQL and gives its name."""
    spark.udtf.register("expand_levels", udtf(ExpandLevels, returnType="level double, target double"))
    return "expand_levels"
