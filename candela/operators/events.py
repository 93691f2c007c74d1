"""Events on candles: rules, forward joins and settlement of brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.scalars import frame, guarded, linear_bps, ratio, series, true_range
from candela.operators.outcomes import first_of, with_path


def rising(cond: Column, quiet: int = 11) -> Column:
    """True where ``cond`` begins and no earlier beginning, suppressed or not, lies in ``quiet`` rows before.
    Needs the column ``_edge`` from ``with_edges``."""
    w = series()
    recent = F.max(F.col("_edge").cast("int")).over(w.rowsBetween(-quiet, -1))
    return F.col("_edge") & (F.coalesce(recent, F.lit(0)) == 0)


def with_edges(bars: DataFrame, cond: Column, to: str = "fires", quiet: int = 11) -> DataFrame:
    """The first row of a series never fires."""
    w = series()
    flagged = bars.withColumn("_cond", F.coalesce(cond, F.lit(False)))
    before = F.lag("_cond").over(w)
    return flagged.withColumn("_edge", F.col("_cond") & ~F.coalesce(before, F.lit(True))).withColumn(to, rising(F.col("_cond"), quiet)).drop("_cond", "_edge")


def confirmed(bars: DataFrame, raw: Column, step: int, n: int = 6, to: str = "confirmed") -> DataFrame:
    """True where ``raw`` held for n rows that are n consecutive steps."""
    w = series()
    ok = (F.col("open_time_ms") - F.lag("open_time_ms").over(w) == step).cast("int")
    r = bars.withColumn("_raw", F.coalesce(raw, F.lit(False)).cast("int")).withColumn("_ok", F.coalesce(ok, F.lit(0)))
    return r.withColumn(to, (F.sum("_raw").over(frame(w, n)) == n) & (F.sum("_ok").over(frame(w, n - 1)) == n - 1)).drop("_raw", "_ok")


def breakouts(bars: DataFrame, n: int = 12, min_z: float = 0.0) -> DataFrame:
    """Rows that close above the highest high of the n rows before, with volume z of 20 rows at least ``min_z``,
    newly so (the row before did not close above its own level)."""
    w = series()
    r = bars.withColumn("level", guarded(F.max, F.col("high"), frame(w, n, -1), n))
    base = frame(w, 20)
    z = ratio(F.col("volume") - F.avg("volume").over(base), F.stddev_pop("volume").over(base))
    r = r.withColumn("z", F.when(F.count("volume").over(base) >= 20, z))
    up = F.col("close") > F.col("level")
    before = F.lag("close").over(w) <= F.lag("level").over(w)
    return r.where(F.lit(True)).withColumn("fires", F.coalesce(up & before & (F.col("z") >= min_z), F.lit(False)))


def bracket_outcomes(events: DataFrame, bars: DataFrame, step: int, horizon: int, target_bps: float, stop_bps: float, side: int = 1,
                     gaps: bool = True, cost_bps: float = 10.0, bucket: int = 64) -> DataFrame:
    """Settle events (symbol, open_time_ms) against the later candles: enter at the next open, leave at the
    first target or stop (stop first in one candle), at the last close after ``horizon`` candles, or stay
    ``DATA_MISSING`` if a candle of the horizon is absent before any touch.

    One bucketed interval join gives each event its candles as an array; entry, touches and the check for gaps are read from it.
    """
    r = with_path(events.select("symbol", F.col("open_time_ms").alias("event_ms")), bars, step, horizon, bucket)
    r = r.withColumn("start", F.try_element_at("path", F.lit(1))).where("start.k = 1").withColumn("entry", F.col("start.open"))
    target, stop = F.col("entry") * (1 + side * target_bps / 10_000), F.col("entry") * (1 - side * stop_bps / 10_000)
    beyond = lambda x, level, up: (x >= level) if up else (x <= level)
    hit_t = lambda x: beyond(x.high if side > 0 else x.low, target, side > 0)
    hit_s = lambda x: beyond(x.low if side > 0 else x.high, stop, side < 0)
    r = r.withColumn("hit", first_of(F.col("path"), lambda x: hit_s(x) | hit_t(x)))
    h = F.col("hit")
    inside = (h.k > 1) & F.lit(gaps)  # the entry candle opens at the entry price
    reason = F.when(hit_s(h), F.when(beyond(h.open, stop, side < 0) & inside, "STOP_GAP").otherwise("STOP")).when(hit_t(h), F.when(beyond(h.open, target, side > 0) & inside, "TARGET_GAP").otherwise("TARGET"))
    r = r.withColumns({"reason": reason, "seen": F.when(h.isNotNull(), F.size(F.filter("path", lambda x: x.k <= h.k)) == h.k).otherwise(F.size("path") == horizon)})
    price = F.when(F.col("reason").isin("STOP_GAP", "TARGET_GAP"), h.open).when(F.col("reason") == "STOP", stop).when(F.col("reason") == "TARGET", target).otherwise(F.element_at("path", -1).close)
    exit_ = F.when(F.col("seen"), price)
    gross = linear_bps(F.col("entry"), exit_, side)
    return r.select(
        "symbol", "event_ms", "entry", F.when(~F.col("seen"), "DATA_MISSING").otherwise(F.coalesce("reason", F.lit("TIME_EXIT"))).alias("reason"),
        F.when(F.col("seen"), F.coalesce(h.k, F.lit(horizon))).cast("long").alias("held"), exit_.alias("exit"), gross.alias("gross_bps"), (gross - cost_bps).alias("net_bps"))


def forward_touch(bars: DataFrame, step: int, horizon: int, up_bps: float, down_bps: float) -> DataFrame:
    """Every row's first touch of log-symmetric barriers within the next ``horizon`` rows: UP, DOWN, BOTH or
    NONE, and the offset of the exit. Levels differ by row, so the look-ahead is unrolled."""
    w = series()
    up, down = F.col("close") * F.exp(F.lit(up_bps / 10_000)), F.col("close") * F.exp(F.lit(-down_bps / 10_000))
    first_up = F.coalesce(*[F.when(F.lead("high", k).over(w) >= up, F.lit(k)) for k in range(1, horizon + 1)])
    first_down = F.coalesce(*[F.when(F.lead("low", k).over(w) <= down, F.lit(k)) for k in range(1, horizon + 1)])
    r = bars.withColumns({"_u": first_up, "_d": first_down, "timeout_bps": F.log(F.lead("close", horizon).over(w) / F.col("close")) * 10_000, "_end": F.lead("open_time_ms", horizon).over(w)})
    touch = F.when(F.col("_u").isNull() & F.col("_d").isNull(), "NONE").when(F.col("_u") == F.col("_d"), "BOTH").when(F.col("_d").isNull() | (F.col("_u") < F.col("_d")), "UP").otherwise("DOWN")
    return r.where("_end is not null").withColumn("touch", touch).withColumn("exit_offset", F.least("_u", "_d", F.lit(horizon))).drop("_u", "_d", "_end")


def time_exits(events: DataFrame, bars: DataFrame, step: int, holds: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """Log returns from the next open to the close h candles on; null if a candle in between is missing."""
    w = series()
    r = bars.withColumn("_entry", F.when(F.lead("open_time_ms").over(w) == F.col("open_time_ms") + step, F.lead("open").over(w)))
    for h in holds:
        there = F.lead("close_time_ms", h).over(w) == F.col("close_time_ms") + h * step
        r = r.withColumn(f"ret_{h}", F.when(there, F.log(F.lead("close", h).over(w) / F.col("_entry")) * 10_000))
    keep = events.select("symbol", "open_time_ms")
    return r.join(keep, ["symbol", "open_time_ms"], "left_semi").select("symbol", "open_time_ms", *[f"ret_{h}" for h in holds])


def features(bars: DataFrame) -> DataFrame:
    """Momentum, Bollinger z, volume z, candle pressure and range features of each row, from rows up to it."""
    w = series()
    r = bars.withColumn("_tr", true_range(w)).withColumn("_atr", guarded(F.avg, F.col("_tr"), frame(w, 14), 14))
    r = r.withColumn("atr_pct", F.greatest(ratio(F.col("_atr"), F.col("close")), F.lit(1e-9))).withColumn("_lv", F.log1p("volume"))
    mom = {f"momentum_{k}": ratio(F.log(F.col("close") / F.lag("close", k).over(w)), F.col("atr_pct")) for k in (1, 3, 12)}
    b = frame(w, 20)
    z = lambda x: F.when(F.count(x).over(b) >= 20, ratio(x - F.avg(x).over(b), F.stddev_pop(x).over(b)))
    return r.withColumns({
        **mom, "bollinger_z": z(F.col("close")), "volume_z": z(F.col("_lv")), "log_atr_pct": F.log("atr_pct"),
        "pressure": ratio(2 * F.col("close") - F.col("high") - F.col("low"), F.col("high") - F.col("low")),
    }).drop("_tr", "_atr", "_lv")
