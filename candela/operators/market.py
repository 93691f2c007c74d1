"""Indicator columns of candle series, and the event rules that read them.

``indicators`` gives one wide frame; a rule is one predicate over its columns (text that Spark SQL
parses), so all rules are read from one pass over the windows. Windows and EMA spans are those of the
rules; thresholds are parameters where they depend on the market.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.ewm import ewms, span
from candela.functions.scalars import frame, guarded, ratio, series, true_range
from candela.functions.slices import in_slices
from candela.sources.files import kept

#: EMA spans and the number of values from which each is known.
EMAS = {20: 20, 50: 50, 200: 200, 576: 288, 1200: 1200}
#: Rows back whose ema50 the trend rules compare.
EMA_LAGS = (4, 6, 12, 24)
RETURNS = (4, 6, 12, 16, 24, 168)
#: Rows back after which the slowest mean (span 1200) has forgotten to within e^-60.
REACH = 60 * 1201 // 2
HIGHS, LOWS = (12, 24, 48, 144, 288), (12, 24)


def emas(bars: DataFrame, spans: dict[int, int] | None = None) -> DataFrame:
    return ewms(bars, {f"ema{n}": ("close", span(n), least) for n, least in (spans or EMAS).items()})


def changes(bars: DataFrame) -> DataFrame:
    """Gains and losses of the close; null in the first row."""
    d = F.col("close") - F.lag("close").over(series())
    return bars.withColumn("_d", d).withColumns({"_g": F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0))), "_l": F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0)))}).drop("_d")


def rsi_of(gain: str, loss: str) -> Column:
    """RSI from 0 to 100 of two means: no losses give 100, then no gains give 0."""
    g, x = F.col(gain), F.col(loss)
    return F.when(g.isNotNull(), F.when(g == 0, 0.0).when(x == 0, 100.0).otherwise(100 - 100 / (1 + g / F.nullif(loss, F.lit(0.0)))))


def indicators(bars: DataFrame) -> DataFrame:
    """Candles with every column that the rules read (see the module's constants)."""
    w = series()
    close = F.col("close")
    r = changes(bars.withColumn("tr", true_range(w)))
    wilder = {"atr": ("tr", 1 / 14, 14), "_eg": ("_g", 1 / 14, 14), "_el": ("_l", 1 / 14, 14)}
    r = ewms(r, {**{f"ema{n}": ("close", span(n), least) for n, least in EMAS.items()}, **wilder}).withColumn("rsi", rsi_of("_eg", "_el")).drop("_g", "_l", "_eg", "_el")
    back = lambda c, k=1: F.lag(c, k).over(w)
    b = frame(w, 20)
    r = r.withColumns({
        "pc": back("close"), "po": back("open"), "ph": back("high"), "pl": back("low"), "pv": back("volume"), "pema20": back("ema20"), "prsi": back("rsi"),
        **{f"ema50_{k}": back("ema50", k) for k in EMA_LAGS}, **{f"ret{k}": close / back("close", k) - 1 for k in RETURNS},
        "lr": F.log(close) - F.log(back("close")), "lv": F.log1p("volume"), "r6": F.log(close / back("close", 6)), "r288": F.log(close / back("close", 288)),
        "mean20": guarded(F.avg, close, b, 20), "sd20": guarded(F.stddev_pop, close, b, 20), "tr14": guarded(F.avg, F.col("tr"), frame(w, 14), 14),
        **{f"hi{n}": guarded(F.max, F.col("high"), frame(w, n, -1), n) for n in HIGHS}, **{f"lo{n}": guarded(F.min, F.col("low"), frame(w, n, -1), n) for n in LOWS},
        "vmean20": guarded(F.avg, F.col("volume"), frame(w, 20, -1), 20), "quote288": guarded(F.sum, F.col("quote_volume"), frame(w, 288), 288),
        "qmed24": F.when(F.count("quote_volume").over(frame(w, 24, -1)) >= 18, F.percentile("quote_volume", 0.5).over(frame(w, 24, -1))),
        "taker_ratio": ratio(F.col("taker_buy_base"), F.col("volume")), "rn": F.row_number().over(w),
    })
    day = frame(w, 288)
    r = r.withColumns({
        "sigma": guarded(F.stddev_samp, F.col("lr"), day, 144), "lvm": guarded(F.avg, F.col("lv"), day, 144), "lvs": guarded(F.stddev_samp, F.col("lv"), day, 144),
        "vol_ratio": ratio(F.col("quote_volume"), F.col("qmed24")), "bb_low": F.col("mean20") - 2 * F.col("sd20"), "bb_high": F.col("mean20") + 2 * F.col("sd20"),
        "phi12": back("hi12"), "phi48": back("hi48"),
    })
    squeeze = lambda width: (F.col("bb_high") < F.col("ema20") + 1.5 * F.col(width)) & (F.col("bb_low") > F.col("ema20") - 1.5 * F.col(width))
    r = r.withColumns({"vz": ratio(F.col("lv") - F.col("lvm"), F.col("lvs")), "squeeze": F.coalesce(squeeze("atr"), F.lit(False)), "squeeze14": F.coalesce(squeeze("tr14"), F.lit(False)),
                       "sigma30": F.col("sigma") * F.sqrt(F.lit(6.0)), "pr6": back("r6"), "pr288": back("r288")})
    return r.withColumns({"psqueeze": F.coalesce(back("squeeze"), F.lit(False)), "psigma30": back("sigma30"),
                          "recent_squeeze": F.coalesce(F.max(F.col("squeeze14").cast("int")).over(frame(w, 6, -1)), F.lit(0)) > 0})


def with_benchmark(ind: DataFrame, symbol: str) -> DataFrame:
    """Exact-time columns of one series beside all others, nothing filled. ``b_bull``/``b_bear`` compare the benchmark with
    its own rows 6 and 12 back; ``b_bull4``/``b_bear4`` with the aligned row 4 of the coin's rows back."""
    trend = lambda up, k: (F.col("close") > F.col("ema50")) & (F.col("ema50") > F.col("ema200")) & (F.col("ema50") > F.col(f"ema50_{k}")) if up else (
        (F.col("close") < F.col("ema50")) & (F.col("ema50") < F.col("ema200")) & (F.col("ema50") < F.col(f"ema50_{k}")))
    b = ind.where(F.col("symbol") == symbol).select(
        "open_time_ms", F.col("close").alias("b_close"), F.col("ema50").alias("b_ema50"), F.col("ema200").alias("b_ema200"), F.col("ret24").alias("b_ret24"),
        *[F.coalesce(trend(up, k), F.lit(False)).alias(f"b_{name}{k}") for name, up in (("bull", True), ("bear", False)) for k in (6, 12)])
    r = ind.join(b, "open_time_ms", "left")
    back = lambda c, k: F.lag(c, k).over(series())
    past = back("b_ema50", 4)
    return r.withColumns({
        "b_bull4": (F.col("b_close") > F.col("b_ema50")) & (F.col("b_ema50") > F.col("b_ema200")) & (F.col("b_ema50") > past),
        "b_bear4": (F.col("b_close") < F.col("b_ema50")) & (F.col("b_ema50") < F.col("b_ema200")) & (F.col("b_ema50") < past),
        "rs4": F.col("ret4") - (F.col("b_close") / back("b_close", 4) - 1), "rs16": F.col("ret16") - (F.col("b_close") / back("b_close", 16) - 1),
        "rs12": F.col("ret12") - (F.col("b_close") / back("b_close", 12) - 1), "low4": F.min("low").over(frame(series(), 4, -1)),
    })


def with_breadth(ind: DataFrame) -> DataFrame:
    """Cross-sectional shares at each time: ``eligible`` and ``breadth`` of risers, ``above`` of ema50 over ema200."""
    valid = F.col("ema200").isNotNull() & F.col("ret24").isNotNull()
    up = valid & (F.col("close") > F.col("ema50")) & (F.col("ema20") > F.col("ema50")) & (F.col("ret24") > 0)
    g = ind.groupBy("open_time_ms").agg(F.count_if(valid).alias("eligible"), F.count_if(up).alias("risers"), F.avg(F.coalesce(F.col("ema50") > F.col("ema200"), F.lit(False)).cast("double")).alias("above"))
    return ind.join(g.withColumn("breadth", ratio(F.col("risers").cast("double"), F.col("eligible").cast("double"))), "open_time_ms")


TREND = "close > ema200 and ema50 > ema200 and ema50 > ema50_12"
OWN_UP, OWN_DOWN = "close > ema50 and ema20 > ema50 and ema50 > ema50_6", "close < ema50 and ema20 < ema50 and ema50 < ema50_6"
UP4, DOWN4 = "close > ema50 and ema20 > ema50 and ema50 > ema50_4", "close < ema50 and ema20 < ema50 and ema50 < ema50_4"
CROSS12 = "close > hi12 and pc <= phi12"


def study_rules(flow: float = 1.5, taker: float = 0.55, lead: float = 0.03, least_markets: int = 100, share: float = 0.65, liquid: float = 5_000_000, fall: float = 0.03) -> dict[str, str]:
    """Predicates by rule name. Defaults are the studies' thresholds."""
    confirmed = f"volume >= {flow} * vmean20 and taker_ratio >= {taker}"
    inflow, outflow = f"vol_ratio >= {flow} and taker_ratio >= {taker}", f"vol_ratio >= {flow} and taker_ratio <= {round(1 - taker, 6)}"
    return {
        "TREND_BREAKOUT_12": f"{TREND} and {CROSS12}",
        "TREND_BREAKOUT_48": f"{TREND} and close > hi48 and pc <= phi48",
        "BULL_VOLUME_BREAKOUT_12": f"{TREND} and {CROSS12} and {confirmed}",
        "EMA20_RECLAIM": f"close > ema20 and pc <= pema20 and close > ema50 and {TREND}",
        "BULL_SQUEEZE_RELEASE": f"{TREND} and b_bull12 and psqueeze and not squeeze and close > open and close > ema20 and {confirmed}",
        "BULL_BREAKOUT_FLOW": f"{OWN_UP} and b_bull6 and close > hi24 and {inflow}",
        "BULL_EMA_RECLAIM": f"{OWN_UP} and b_bull6 and close > ema20 and pc <= pema20 and ret24 > 0",
        "BULL_RELATIVE_STRENGTH": f"{OWN_UP} and b_bull6 and ret24 >= b_ret24 + {lead} and vol_ratio >= 1.0 and taker_ratio >= 0.52",
        "BEAR_BREAKDOWN_FLOW": f"{OWN_DOWN} and b_bear6 and close < lo24 and {outflow}",
        "BEAR_EMA_REJECT": f"{OWN_DOWN} and b_bear6 and close < ema20 and pc >= pema20 and ret24 < 0",
        "BEAR_RELATIVE_WEAKNESS": f"{OWN_DOWN} and b_bear6 and ret24 <= b_ret24 - {lead} and vol_ratio >= 1.0 and taker_ratio <= 0.48",
        "BREADTH_BREAKOUT": f"b_bull6 and eligible >= {least_markets} and breadth >= {share} and {OWN_UP} and {inflow} and close > hi12",
        "HOURLY_SQUEEZE_RELEASE": f"b_bull6 and {OWN_UP} and psqueeze and not squeeze and close > open and close > ema20 and {inflow}",
        "FLOW_BREAKOUT_LONG": f"{UP4} and b_bull4 and close > hi12 and {inflow}",
        "FLOW_BREAKOUT_SHORT": f"{DOWN4} and b_bear4 and close < lo12 and {outflow}",
        "RS_PULLBACK": "b_bull4 and close > ema200 and ema20 > ema50 and ema50 > ema50_4 and low4 <= pema20 and close > ema20 and close > open and rs4 > 0 and rs16 > 0 and vol_ratio >= 1.2 and taker_ratio >= 0.5",
        "RSI_EXHAUSTION_LONG": "prsi <= 30 and rsi > 30 and close > open and close > ema200",
        "RSI_EXHAUSTION_SHORT": "prsi >= 70 and rsi < 70 and close < open and close < ema200",
        "BB_SNAPBACK_LONG": "low < bb_low and close > bb_low and close > open and close > ema200",
        "BB_SNAPBACK_SHORT": "high > bb_high and close < bb_high and close < open and close < ema200",
        "FALL_RECLAIM": f"pl <= {round(1 - fall, 6)} * fall_high and pl <= fall_low and pc < po and fall_volume > 0 and pv >= 2 * fall_volume and close > ph and close > open and quote288 >= {liquid}",
        "MARKET_BREAKOUT": f"{MARKET_UP} and close > hi12 and ret12 < 0.025",
        "MARKET_PULLBACK": f"{MARKET_UP} and close > ema20 and pc <= pema20 and close > ema50",
        "MARKET_RELATIVE_STRENGTH": f"{MARKET_UP} and rs12 >= 0.01 and close > hi48",
    }


MARKET_UP = "b_close > b_ema200 and b_ema50 > b_ema200 and b_bull12 and above >= 0.55 and close > ema200 and ema50 > ema200 and ema50 > ema50_12"


def with_fall_levels(ind: DataFrame) -> DataFrame:
    """Levels that leave out the falling row before the current one."""
    w = series()
    return ind.withColumns({"fall_high": guarded(F.max, F.col("high"), frame(w, 12, -2), 12), "fall_low": guarded(F.min, F.col("low"), frame(w, 12, -2), 12),
                            "fall_volume": F.when(F.count("volume").over(frame(w, 20, -2)) >= 20, F.percentile("volume", 0.5).over(frame(w, 20, -2)))})


def hits(ind: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(symbol, open_time_ms, rule): one row for each rule that holds."""
    found = F.array_compact(F.array(*[F.when(F.expr(p), F.lit(k)) for k, p in rules.items()]))
    return ind.select("symbol", "open_time_ms", F.explode(found).alias("rule"))


def rule_sets(found: DataFrame) -> DataFrame:
    """The set of rules of each symbol and candle, as one sorted text."""
    return found.groupBy("symbol", "open_time_ms").agg(F.array_join(F.sort_array(F.collect_set("rule")), "+").alias("rules"), F.count_distinct("rule").alias("n"))


def live_conditions(z1: float = 3.0, z2: float = 2.0, shock: float = 3.0) -> dict[str, tuple[str, str, str]]:
    """family: (condition whose new edge fires, further condition, score)."""
    return {
        "F1": (f"vz >= {z1}", "close > open", f"vz / {z1}"),
        "F2": (f"r6 <= -{shock} * sigma30 and sigma30 > 0 and vz >= {z2}", "true", f"least(-r6 / sigma30 / {shock}, vz / {z2})"),
        "F3": (f"close > hi144 and vz >= {z2}", "true", f"vz / {z2} + least(ln(close / hi144) * 10000 / greatest(sigma * 10000, 1e-9), 1.0)"),
        "B1": ("close > hi288 and vz >= 1.0", "gate", "1.0 + greatest(vz, 0.0) / 3.0 + least(ln(close / hi288) * 10000 / 25.0, 1.0)"),
        "B2": ("pr6 <= -0.75 * psigma30 and pr6 >= -6.0 * psigma30 and psigma30 > 0 and close > open and close > ph and close > ema576 and vz >= 0.5", "gate",
               "1.0 + least(greatest(ln(close / pc) * 10000, 0.0) / 25.0, 1.0) + greatest(vz, 0.0) / 4.0"),
        "B4": ("recent_squeeze and close > bb_high and (close > ema20 + 1.5 * tr14 or not squeeze14) and close > open and close > ema576 and vz >= 1.0", "gate and taker12 >= 0.54 and bb_high > 0",
               "1.2 + least(greatest(ln(close / bb_high) * 10000, 0.0) / 25.0, 1.0) + greatest(vz, 0.0) / 3.0"),
    }


def live_marks(ind: DataFrame, quiet: int = 11, **limits: float) -> DataFrame:
    """The frame with ``taker12`` and, for each family, ``f_<family>``: its condition begins here and did not begin in the ``quiet`` rows before."""
    w = series()
    rules = live_conditions(**limits)
    r = ind.withColumns({"taker12": F.least(F.greatest(ratio(F.sum("taker_buy_base").over(frame(w, 12)), F.sum("volume").over(frame(w, 12))), F.lit(0.0)), F.lit(1.0)), **{f"c_{k}": F.coalesce(F.expr(c), F.lit(False)) for k, (c, _, _) in rules.items()}})
    r = r.withColumns({f"e_{k}": F.col(f"c_{k}") & ~F.coalesce(F.lag(f"c_{k}").over(w), F.lit(True)) for k in rules})
    quiet_rows = w.rowsBetween(-quiet, -1)
    r = r.withColumns({f"f_{k}": F.col(f"e_{k}") & (F.coalesce(F.max(F.col(f"e_{k}").cast("int")).over(quiet_rows), F.lit(0)) == 0) for k in rules})
    return r.drop(*(f"{x}_{k}" for k in rules for x in "ce"))


def live_frame(bars: DataFrame, size: int = 65_536, quiet: int = 11, **limits: float) -> DataFrame:
    """``indicators`` with ``live_marks``, computed once in slices of ``size`` rows of a series and kept in the shared folder: the
    families, the gate and the regime all read it. ``rn`` counts from the slice's halo on, so it is exact below ``REACH``."""
    bars = kept(bars, "bars")  # the slices read them several times
    return kept(in_slices(bars, lambda b: live_marks(indicators(b), quiet, **limits), before=REACH, size=size), "live")


def _fires(**limits: float) -> list[Column]:
    """(family, score) of each family that fires; they read the marks, ``gate`` and ``taker12``."""
    rules = live_conditions(**limits)
    return [F.when(F.col(f"f_{k}") & F.expr(more), F.struct(F.lit(k).alias("family"), F.expr(score).alias("score"))) for k, (_, more, score) in rules.items()]


def _relative(least_markets: int) -> Column:
    """(family, score) where B3 enters, from cross-sections of the rows whose return of the bar before is known; reads ``gate``."""
    at = Window.partitionBy("open_time_ms")
    known = F.col("pr288").isNotNull()
    cut = lambda c: F.percentile(F.when(known, F.col(c)), 0.9).over(at)
    enters = known & F.col("gate") & (F.count("pr288").over(at) >= least_markets) & (F.col("r288") >= cut("r288")) & (F.col("pr288") < cut("pr288")) & (F.col("r6") > 0)
    score = 1.0 + F.least(F.greatest((F.col("r288") - cut("r288")) * 10_000, F.lit(0.0)) / 50.0, F.lit(2.0))
    return F.when(enters, F.struct(F.lit("B3").alias("family"), score.alias("score")))


def live_families(marked: DataFrame, gate: Column, least_markets: int = 10, **limits: float) -> DataFrame:
    """(symbol, open_time_ms, family, score) of all live families from a marked frame, in one pass. The B families need ``gate``
    (a bullish or transitional market)."""
    r = marked.withColumn("gate", F.coalesce(gate, F.lit(False)))
    r = r.select("symbol", "open_time_ms", F.array(*_fires(**limits), _relative(least_markets)).alias("_x"))
    return r.select("symbol", "open_time_ms", F.explode(F.array_compact("_x")).alias("x")).select("symbol", "open_time_ms", "x.family", "x.score")


def live_rules(ind: DataFrame, gate: Column, quiet: int = 11, **limits: float) -> DataFrame:
    """The families without B3 from plain indicators."""
    r = live_marks(ind.withColumn("gate", F.coalesce(gate, F.lit(False))), quiet, **limits)
    return r.select("symbol", "open_time_ms", F.explode(F.array_compact(F.array(*_fires(**limits)))).alias("x")).select("symbol", "open_time_ms", "x.family", "x.score")


def relative_entries(ind: DataFrame, gate: Column, least_markets: int = 10) -> DataFrame:
    """Family B3: into the top decile of the 288-row return at this bar, below it at the one before, rising over 6 rows."""
    r = ind.withColumn("gate", F.coalesce(gate, F.lit(False))).select("symbol", "open_time_ms", _relative(least_markets).alias("x"))
    return r.where("x is not null").select("symbol", "open_time_ms", "x.family", "x.score")


def bull_regime(ind: DataFrame, majors: tuple[str, str], threshold: float = 0.60) -> DataFrame:
    """One row for each time: breadth over ema576, four trend votes of the two majors over ema1200, persistence over 672
    rows now and 168 rows ago; score and state. Fewer than four votes or no breadth: UNKNOWN."""
    w = series()
    breadth = ind.groupBy("open_time_ms").agg(F.avg((F.col("close") > F.col("ema576")).cast("double")).alias("breadth"), F.count("ema576").alias("votes"))
    back = lambda c, k: F.lag(c, k).over(w)
    m = ind.where(F.col("symbol").isin(*majors)).withColumns({
        "old": back("ema1200", 168), "now4": F.log(F.col("close") / back("close", 672)), "then4": F.log(back("close", 168) / back("close", 840))}).where("rn >= 1369 and ema1200 is not null and old is not null")
    m = m.groupBy("open_time_ms").agg(
        F.count("*").alias("n"), (F.sum((F.col("close") > F.col("ema1200")).cast("double") + (F.col("ema1200") > F.col("old")).cast("double")) / 4).alias("trend"),
        ((F.avg("now4") > 0) & (F.avg("then4") > 0)).alias("persistent"))
    r = breadth.join(m, "open_time_ms", "left")
    known = (F.col("n") == len(majors)) & (F.col("votes") > 0)
    score = 0.4 * F.col("persistent").cast("double") + 0.3 * F.col("trend") + 0.3 * F.least(F.col("breadth") / threshold, F.lit(1.0))
    r = r.withColumns({"known": F.coalesce(known, F.lit(False)), "raw": score})
    state = F.when(~F.col("known"), "UNKNOWN").when(F.col("persistent") & (F.col("trend") >= 0.75) & (F.col("breadth") >= threshold), "BULL").when(F.col("raw") >= 0.55, "TRANSITION").otherwise("OFF")
    zero = lambda c: F.when(F.col("known"), F.col(c)).otherwise(0.0)
    return r.select("open_time_ms", state.alias("state"), zero("raw").alias("score"), F.coalesce("breadth", F.lit(0.0)).alias("breadth"), zero("trend").alias("trend_fraction"), (F.col("known") & F.coalesce("persistent", F.lit(False))).alias("persistent_up"), F.coalesce("votes", F.lit(0)).alias("votes"))


def market_context(bars: DataFrame) -> DataFrame:
    """Each symbol's last row: 288-row return in percent, volume of 12 rows over the median of 24 earlier disjoint 12-row sums,
    taker share of 12 rows, median true range of 24 rows in bps, and the rank by return. Needs 289 rows."""
    w = series()
    sums = F.sort_array(F.array(*[F.lag("s12", 12 * k).over(w) for k in range(1, 25)]))
    r = bars.withColumns({"rn": F.row_number().over(w), "range_bps": ratio(true_range(w), F.col("close")) * 10_000, "s12": F.sum("volume").over(frame(w, 12)), "t12": F.sum("taker_buy_base").over(frame(w, 12))})
    r = r.withColumns({"old": sums, "last": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("open_time_ms"))), "return_pct": (F.col("close") / F.lag("close", 288).over(w) - 1) * 100,
                       "volatility_bps": F.percentile("range_bps", 0.5).over(frame(w, 24))})
    base = (F.element_at("old", 12) + F.element_at("old", 13)) / 2
    r = r.where("last = 1 and rn >= 289").select("symbol", "open_time_ms", "return_pct", F.when(F.col("rn") >= 300, F.when(base > 0, F.col("s12") / base)).alias("volume_ratio"),
        F.least(F.greatest(ratio(F.col("t12"), F.col("s12")), F.lit(0.0)), F.lit(1.0)).alias("taker_ratio"), "volatility_bps")
    # one row for each symbol
    return r.withColumns({"rank": F.row_number().over(Window.orderBy(F.desc("return_pct"), "symbol")), "universe": F.count("*").over(Window.partitionBy())})


def scout_features(bars: DataFrame, benchmark: str, ready: int = 335) -> DataFrame:
    """Trend, strength against the benchmark, volume, compression and breakout columns of the long scout."""
    w = series()
    b = bars.where(F.col("symbol") == benchmark).select("open_time_ms", F.col("close").alias("b_close"))
    r = emas(bars, {20: 20, 50: 50, 200: 200}).join(b, "open_time_ms", "left")
    back = lambda c, k=1: F.lag(c, k).over(w)
    c = F.col("close")
    whole = lambda agg, x, n, upto=0: guarded(agg, x, frame(w, n, upto), n)
    r = r.withColumns({
        "return24": (c / back("close", 24) - 1) * 100, "return7d": (c / back("close", 168) - 1) * 100, "tr": true_range(w), "rn": F.row_number().over(w),
        "rs24": ((c / back("close", 24)) / (F.col("b_close") / back("b_close", 24)) - 1) * 100, "rs7d": ((c / back("close", 168)) / (F.col("b_close") / back("b_close", 168)) - 1) * 100,
        "quote24": whole(F.sum, F.col("quote_volume"), 24), "quote4": whole(F.sum, F.col("quote_volume"), 4), "mean168": whole(F.avg, F.col("quote_volume"), 168, -4),
        "span24": (whole(F.max, F.col("high"), 24) / whole(F.min, F.col("low"), 24) - 1) * 100, "high168": whole(F.max, F.col("high"), 168, -1),
        "taker_ratio": ratio(whole(F.sum, F.col("taker_buy_base"), 4), whole(F.sum, F.col("volume"), 4)), "ema50_24": back("ema50", 24), "pema20": back("ema20"), "pc": back("close"),
    })
    span = frame(w, 168, -24)
    r = r.withColumns({
        "volume4": ratio(F.col("quote4"), F.col("mean168") * 4), "atr_pct": guarded(F.avg, F.col("tr"), frame(w, 14), 14) / c * 100, "breakout_pct": (c / F.col("high168") - 1) * 100,
        "compression": ratio(back("span24", 4), F.when(F.count("span24").over(span) >= 168, F.percentile("span24", 0.5).over(span))),
        "close_position": ratio(c - F.col("low"), F.col("high") - F.col("low")),
        "trend": F.coalesce(F.expr("close > ema20 and ema20 > ema50 and ema50 > ema50_24"), F.lit(False)),
        "macro_trend": F.coalesce(F.expr("close > ema50 and ema50 > ema200 and ema50 > ema50_24 and return7d > 0"), F.lit(False)),
        "retest": F.coalesce(F.expr("pc <= pema20 and close > ema20 and abs(close / ema20 - 1) <= 0.02"), F.lit(False)), "ready": F.col("rn") > ready,
    })
    return r.select("symbol", "open_time_ms", "close", "return24", "return7d", "rs24", "rs7d", "quote24", "volume4", "compression", "atr_pct", "breakout_pct", "close_position", "taker_ratio", "trend", "macro_trend", "retest", "ready")


#: The scout's candidate conditions, first that holds: strategy, stage, predicate.
SCOUT = (("LB1", "CONFIRMED", "breakout_pct > 0 and breakout_pct <= 3 and volume4 >= 1.8 and close_position >= 0.7"),
         ("LP1", "CONFIRMED", "retest and breakout_pct between -8 and 0 and volume4 >= 1.2 and taker_ratio >= 0.53"),
         ("LA1", "WATCH", "compression <= 0.85 and volume4 >= 1.15 and breakout_pct between -10 and 0"))
SCOUT_GATE = ("ready and trend and rs7d >= {rs7d} and rs24 > 0 and quote24 >= {volume} and atr_pct between 0.2 and {atr} and return24 <= {rise} and return7d between -10 and {week} "
              "and compression is not null and volume4 is not null and breakout_pct is not null and close_position is not null and taker_ratio is not null")
SCOUT_SCORE = ("20 * least(1.0, greatest(0.0, rs7d / 12)) + 10 * least(1.0, greatest(0.0, rs24 / 4)) + 20.0 + 20 * least(1.0, greatest(0.0, volume4 / 3)) "
               "+ 15 * least(1.0, greatest(0.0, 1 - compression)) + 15 * least(1.0, greatest(0.0, close_position))")


def scout_candidates(features: DataFrame, least_score: float = 60.0, least_watch: float = 50.0, rs7d: float = 3, volume: float = 5_000_000, atr: float = 6, rise: float = 15, week: float = 40) -> DataFrame:
    """Candidates with strategy, stage, score (two decimals) and a stop of 2 ATR between 2 and 6 percent."""
    r = features.where(SCOUT_GATE.format(rs7d=rs7d, volume=volume, atr=atr, rise=rise, week=week))
    strategy, stage = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, at, p in reversed(SCOUT):
        strategy, stage = F.when(F.expr(p), name).otherwise(strategy), F.when(F.expr(p), at).otherwise(stage)
    r = r.withColumns({"strategy": strategy, "stage": stage, "raw": F.expr(SCOUT_SCORE)}).where("strategy is not null")
    r = r.where(F.col("raw") >= F.when(F.col("stage") == "WATCH", least_watch).otherwise(least_score))
    return r.select("symbol", "open_time_ms", "strategy", "stage", F.bround("raw", 2).alias("score"), F.least(F.lit(6.0), F.greatest(F.lit(2.0), 2 * F.col("atr_pct"))).alias("stop_pct"))


def established_bull(features: DataFrame, majors: tuple[str, str], step: int, need: int = 6, coverage: float = 0.8, breadth: float = 0.6) -> DataFrame:
    """At the times that both majors have: coverage and breadth over all symbols, the raw bull flag, and whether it held for
    ``need`` consecutive steps."""
    total = features.select("symbol").distinct().agg(F.count("*").alias("symbols"))
    g = features.groupBy("open_time_ms").agg(F.count_if("ready").alias("n_ready"), F.count_if(F.col("ready") & (F.col("return24") > 0)).alias("n_up"),
        F.count_if(F.col("symbol").isin(*majors)).alias("n_majors"), F.count_if(F.col("symbol").isin(*majors) & F.col("macro_trend")).alias("n_trend")).where(F.col("n_majors") == len(majors))
    g = g.crossJoin(F.broadcast(total)).withColumns({"coverage": F.col("n_ready") / F.col("symbols"), "breadth": ratio(F.col("n_up").cast("double"), F.col("n_ready").cast("double"))})
    g = g.withColumn("raw_bull", F.coalesce((F.col("n_trend") == len(majors)) & (F.col("coverage") >= coverage) & (F.col("breadth") >= breadth), F.lit(False)))
    # one row for each time of the whole market: a single ordered series
    w = Window.orderBy("open_time_ms")
    ok = F.coalesce(F.col("open_time_ms") - F.lag("open_time_ms").over(w) == step, F.lit(False)).cast("int")
    g = g.withColumn("ok", ok)
    held = (F.sum(F.col("raw_bull").cast("int")).over(w.rowsBetween(1 - need, 0)) == need) & (F.sum("ok").over(w.rowsBetween(2 - need, 0)) == need - 1)
    return g.select("open_time_ms", "coverage", "breadth", "raw_bull", held.alias("established"))


def minute_trigger(bars: DataFrame, step: int, rows: int = 90, most_pct: float = 0.5, least_ratio: float = 1.5, position: float = 0.7) -> DataFrame:
    """Each symbol's last ``rows`` candles, if they are contiguous: does the last one break out on volume above rising averages?"""
    w = series()
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("open_time_ms")))
    r = bars.withColumn("back", newest).where(F.col("back") <= rows)
    r = ewms(r, {f"ema{n}": ("close", span(n), 1) for n in (9, 21)})
    r = r.withColumns({"n": F.count("*").over(Window.partitionBy("symbol")), "first_ms": F.min("open_time_ms").over(Window.partitionBy("symbol")), "hi": guarded(F.max, F.col("high"), frame(w, 30, -1), 30),
                       "q3": F.sum("quote_volume").over(frame(w, 3)), "q60": F.avg("quote_volume").over(frame(w, 60, -3)) * 3})
    r = r.where((F.col("back") == 1) & (F.col("n") == rows) & (F.col("open_time_ms") - F.col("first_ms") == (rows - 1) * step))
    r = r.withColumns({"breakout_pct": (F.col("close") / F.col("hi") - 1) * 100, "volume_ratio": F.coalesce(F.when(F.col("q60") > 0, F.col("q3") / F.col("q60")), F.lit(0.0)), "close_position": F.coalesce(ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))})
    go = (F.col("close") > F.col("ema9")) & (F.col("ema9") > F.col("ema21")) & (F.col("breakout_pct") > 0) & (F.col("breakout_pct") <= most_pct) & (F.col("volume_ratio") >= least_ratio) & (F.col("close_position") >= position)
    return r.select("symbol", "open_time_ms", "ema9", "ema21", "breakout_pct", "volume_ratio", "close_position", F.coalesce(go, F.lit(False)).alias("triggered"))


def accumulation(bars: DataFrame, least: int = 20, most: int = 60, k: float = 2.0) -> DataFrame:
    """The shortest look-back of ``least`` to ``most`` rows whose range is at most k ATR (Wilder), with its bounds; rows without one go."""
    w = series()
    r = ewms(bars.withColumn("tr", true_range(w)), {"atr": ("tr", 1 / 14, 14)})
    hi, lo = (lambda n: F.max("high").over(frame(w, n))), (lambda n: F.min("low").over(frame(w, n)))
    some = [F.when((F.row_number().over(w) >= n) & (hi(n) > lo(n)) & (hi(n) - lo(n) <= k * F.col("atr")), F.struct(F.lit(n).alias("n"), lo(n).alias("low"), hi(n).alias("high"))) for n in range(least, most + 1)]
    return r.withColumn("first", F.coalesce(*some)).where("first is not null").select("symbol", "open_time_ms", "first.n", F.col("first.low").alias("range_low"), F.col("first.high").alias("range_high"))


FEATURES = ("momentum_1", "momentum_3", "momentum_12", "ema_spread", "rsi_centred", "bollinger_z", "log_atr_pct", "volume_z", "pressure")


def feature_frame(bars: DataFrame) -> DataFrame:
    """The nine model features with Wilder's ATR; a zero divisor gives null. Also ``atr`` and ``atr_pct``."""
    w = series()
    r = changes(bars.withColumn("tr", true_range(w)))
    r = ewms(r, {"atr": ("tr", 1 / 14, 14), "_eg": ("_g", 1 / 14, 14), "_el": ("_l", 1 / 14, 14), "_e8": ("close", span(8), 8), "_e21": ("close", span(21), 21)})
    c, lv, b = F.col("close"), F.log1p("volume"), frame(w, 20)
    r = r.withColumn("atr_pct", F.col("atr") / c).withColumns({"_safe": F.greatest("atr_pct", F.lit(1e-9)), "_lv": lv})
    r = r.withColumn("_safe", F.when(F.col("atr_pct").isNotNull(), F.col("_safe")))
    z = lambda x: F.when(F.count(x).over(b) >= 20, ratio(x - F.avg(x).over(b), F.stddev_pop(x).over(b)))
    return r.withColumns({
        **{f"momentum_{k}": F.log(c / F.lag("close", k).over(w)) / F.col("_safe") for k in (1, 3, 12)}, "ema_spread": ratio(F.col("_e8") - F.col("_e21"), F.col("atr")), "rsi_centred": (rsi_of("_eg", "_el") - 50) / 25,
        "bollinger_z": z(c), "log_atr_pct": F.log("_safe"), "volume_z": z(F.col("_lv")), "pressure": ratio(2 * c - F.col("high") - F.col("low"), F.col("high") - F.col("low")),
    }).select(*bars.columns, "atr", "atr_pct", *FEATURES)


def supervised(bars: DataFrame, horizon: int = 12, multiple: float = 1.0, floor_bps: float = 0.0, cost_bps: float = 10.0, least: int = 200) -> DataFrame:
    """Features and triple-barrier labels of every candle with all features and a whole horizon after it. The barrier is a multiple of
    the ATR, at least the floor; both barriers in one candle are BOTH and judged by the timeout. ``long_net`` and ``short_net`` are the
    trades' results (BOTH loses). Series with fewer than ``least`` rows give none."""
    w = series()
    r = feature_frame(bars).withColumn("barrier_bps", F.greatest(multiple * F.col("atr_pct") * 10_000, F.lit(floor_bps)))
    up, down = F.col("close") * F.exp(F.col("barrier_bps") / 10_000), F.col("close") * F.exp(-F.col("barrier_bps") / 10_000)
    r = r.withColumns({"_p": F.collect_list(F.struct("high", "low")).over(w.rowsBetween(1, horizon)), "timeout_bps": F.log(F.lead("close", horizon).over(w) / F.col("close")) * 10_000})
    at = lambda hit: F.nullif(F.array_position(F.transform("_p", hit), True).cast("int"), F.lit(0))
    r = r.where(F.size("_p") == horizon).withColumns({"_u": at(lambda x: x.high >= up), "_d": at(lambda x: x.low <= down)})
    touch = F.when(F.col("_u").isNull() & F.col("_d").isNull(), "NONE").when(F.col("_u") == F.col("_d"), "BOTH").when(F.col("_d").isNull() | (F.col("_u") < F.col("_d")), "UP").otherwise("DOWN")
    r = r.withColumns({"touch": touch, "exit_offset": F.least("_u", "_d", F.lit(horizon))})
    result = lambda side: F.when(F.col("touch") == side, F.col("barrier_bps")).when(F.col("touch") == "NONE", (1 if side == "UP" else -1) * F.col("timeout_bps")).otherwise(-F.col("barrier_bps")) - cost_bps
    r = r.withColumns({"target": F.when(F.col("touch") == "UP", 1).when(F.col("touch") == "DOWN", 0).otherwise((F.col("timeout_bps") > 0).cast("int")), "long_net": result("UP"), "short_net": result("DOWN")})
    r = r.dropna(subset=[*FEATURES, "timeout_bps"]).withColumn("_n", F.count("*").over(Window.partitionBy("symbol"))).where(F.col("_n") >= least)
    return r.select("symbol", "open_time_ms", "close", *FEATURES, "barrier_bps", "touch", "exit_offset", "timeout_bps", "target", "long_net", "short_net")
