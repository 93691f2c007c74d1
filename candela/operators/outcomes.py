"""Forward outcomes of events: one bucketed interval join gives each event its later candles as an array of at most
``horizon`` entries; every outcome is an expression over that array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDLE = ("open", "high", "low", "close")


def with_path(events: DataFrame, bars: DataFrame, step: int, horizon: int, bucket: int = 64) -> DataFrame:
    """Events (symbol, event_ms, ...) with ``path``: their next ``horizon`` steps' candles, sorted by the step k; gaps stay gaps.

    The interval join is an equi join on time buckets: an event goes to the few that its horizon meets, and only its
    key travels; its other columns join the finished arrays.
    """
    width = bucket * step
    keys = events.select("symbol", "event_ms").distinct()
    first, last = F.col("event_ms") + step, F.col("event_ms") + horizon * step
    sent = keys.withColumn("b", F.explode(F.sequence(F.floor(first / width), F.floor(last / width))))
    right = bars.select("symbol", F.col("open_time_ms").alias("t"), *CANDLE, F.floor(F.col("open_time_ms") / width).alias("b"))
    j = sent.join(right, ["symbol", "b"]).where((F.col("t") >= first) & (F.col("t") <= last))
    k = ((F.col("t") - F.col("event_ms")) / step).cast("int").alias("k")
    paths = j.groupBy("symbol", "event_ms").agg(F.sort_array(F.collect_list(F.struct(k, *CANDLE))).alias("path"))
    none = F.array().cast("array<struct<k:int,open:double,high:double,low:double,close:double>>")
    return events.join(paths, ["symbol", "event_ms"], "left").withColumn("path", F.coalesce("path", none))


def first_of(path: Column, hit) -> Column:
    """The first candle for which ``hit`` holds, or null."""
    return F.try_element_at(F.filter(path, hit), F.lit(1))


def prefix(path: Column) -> Column:
    """The candles before the first gap."""
    return F.filter(path, lambda x, i: x.k == i + 1)


def _reached(up: Column, level: Column):
    """Does a candle reach a level above (``up``) or below?"""
    return lambda x: F.when(up, x.high >= level).otherwise(x.low <= level)


def barrier_settlement(events: DataFrame, deadline_ms: Column, now_ms: int, barrier_bps: float, cost_bps: float, grace_ms: int) -> DataFrame:
    """Log-symmetric barriers around ``source``. Both in one candle: UNCLEAR, a loss at that close. No touch: TIME at the last
    close once the deadline is past, OPEN before it, DROPPED when no candle came within the grace time."""
    up, b = F.col("side") > 0, barrier_bps
    upper, lower = F.col("source") * F.exp(F.lit(b / 10_000)), F.col("source") * F.exp(F.lit(-b / 10_000))
    r = events.withColumns({"hit": first_of(F.col("path"), lambda x: (x.high >= upper) | (x.low <= lower)), "last": F.try_element_at("path", F.lit(-1)), "expired": deadline_ms <= now_ms})
    u, d = F.col("hit.high") >= upper, F.col("hit.low") <= lower
    timed = F.col("expired") & F.col("last").isNotNull()
    move = F.log(F.col("last.close") / F.col("source")) * 10_000 * F.col("side")
    result = F.when(u & d, "UNCLEAR").when(u | d, F.when(u == up, "TARGET").otherwise("STOP")).when(timed, "TIME").when(now_ms - deadline_ms > grace_ms, "DROPPED").otherwise("OPEN")
    r = r.withColumns({"resolution": result, "gross_bps": F.when(u & d, -b).when(u | d, F.when(u == up, b).otherwise(-b)).when(timed, move), "held": F.when(F.col("hit").isNotNull(), F.col("hit.k")).when(timed, F.col("last.k"))})
    price = F.when(u & d, F.col("hit.close")).when(u, upper).when(d, lower).when(timed, F.col("last.close"))
    return r.select("symbol", "event_ms", "side", "resolution", "held", price.alias("exit"), "gross_bps", (F.col("gross_bps") - cost_bps).alias("net_bps"))


def first_touch(events: DataFrame, horizon: int, target_bps: Column, stop_bps: Column, cost_bps: float, reached_end: Column, past_grace: Column) -> DataFrame:
    """Brackets on log returns from the next open, read over the gap-free prefix only. A tie is a STOP and marked; TIME_EXIT
    needs the last candle; what stays open is PENDING, and DATA_MISSING past the grace time. MFE and MAE up to the exit."""
    up, s = F.col("side") > 0, F.col("side")
    r = events.withColumn("p", prefix(F.col("path"))).withColumn("entry", F.when(F.size("p") > 0, F.col("p")[0].open))
    r = r.withColumns({"target": F.col("entry") * (1 + s * target_bps / 10_000), "stop": F.col("entry") * (1 - s * stop_bps / 10_000)})
    t, x = _reached(up, F.col("target")), _reached(~up, F.col("stop"))
    r = r.withColumns({"hit": first_of(F.col("p"), lambda c: t(c) | x(c)), "last": F.try_element_at("p", F.lit(-1))})
    whole = reached_end & (F.col("last.k") == horizon)
    stopped = F.when(up, F.col("hit.low") <= F.col("stop")).otherwise(F.col("hit.high") >= F.col("stop"))
    won = F.when(up, F.col("hit.high") >= F.col("target")).otherwise(F.col("hit.low") <= F.col("target"))
    r = r.withColumns({
        "resolution": F.when(stopped, "STOP").when(won, "TARGET").when(whole, "TIME_EXIT").when(past_grace, "DATA_MISSING").otherwise("PENDING"), "ambiguous": F.coalesce(stopped & won, F.lit(False)),
        "held": F.when(F.col("hit").isNotNull(), F.col("hit.k")).when(whole, F.lit(horizon)), "exit": F.when(stopped, F.col("stop")).when(won, F.col("target")).when(whole, F.col("last.close"))})
    r = r.withColumn("lived", F.filter("p", lambda c: c.k <= F.col("held")))
    high, low = F.array_max(F.transform("lived", lambda c: c.high)), F.array_min(F.transform("lived", lambda c: c.low))
    best, worst = F.log(high / F.col("entry")) * 10_000, F.log(F.col("entry") / low) * 10_000
    gross = F.log(F.col("exit") / F.col("entry")) * 10_000 * s
    return r.select("symbol", "event_ms", "side", "entry", "resolution", "ambiguous", "held", gross.alias("gross_bps"), (gross - cost_bps).alias("net_bps"),
                    F.greatest(F.when(up, best).otherwise(worst), F.lit(0.0)).alias("mfe_bps"), F.greatest(F.when(up, worst).otherwise(best), F.lit(0.0)).alias("mae_bps"))


def level_touches(events: DataFrame, horizon: int, levels: tuple[float, ...], past_grace: Column) -> DataFrame:
    """One row for each event and level in percent of ``source``: touched or not, null while the window is incomplete, and the
    step of the touch."""
    up = F.col("side") > 0
    r = events.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    goal = F.col("source") * (1 + F.col("side") * F.col("level") / 100)
    r = r.withColumn("hit", first_of(F.col("path"), _reached(up, goal)))
    touched = F.when(F.col("hit").isNotNull(), True).when((F.size("path") == horizon) | past_grace, False)
    return r.select("symbol", "event_ms", "side", "level", touched.alias("touched"), F.col("hit.k").alias("touch_k"))


def paper_outcome(events: DataFrame, horizon: int, levels: tuple[float, ...], stop_pct: Column, cost_bps: float, mature: Column, cutoff_k: Column, entry: Column | None = None) -> DataFrame:
    """Levels against one stop from the next open (or a stated ``entry`` price). Complete windows only: hit, first before the stop
    (null when one candle has both), net. ``cutoff_k`` is the number of steps that could have been seen."""
    r = events.withColumns({"start": F.try_element_at("path", F.lit(1)), "complete": F.size("path") == cutoff_k, "mature": mature, "stop_pct": stop_pct})
    r = r.withColumn("entry", F.when(F.col("start.k") == 1, F.coalesce(entry, F.col("start.open")) if entry is not None else F.col("start.open"))).where("entry is not null")
    gain, loss = (lambda x: (x.high / F.col("entry") - 1) * 100), (lambda x: (1 - x.low / F.col("entry")) * 100)
    r = r.withColumns({"stop_k": first_of(F.col("path"), lambda x: loss(x) >= F.col("stop_pct") - 1e-9).k, "last": F.try_element_at("path", F.lit(-1)), "level": F.explode(F.array(*[F.lit(float(x)) for x in levels]))})
    r = r.withColumn("hit_k", first_of(F.col("path"), lambda x: gain(x) >= F.col("level") - 1e-9).k)
    r = r.withColumn("ambiguous", F.coalesce(F.col("hit_k") == F.col("stop_k"), F.lit(False)))
    c, m = F.col("complete"), F.col("mature")
    before = F.when(~c | F.col("ambiguous"), None).when(F.col("hit_k").isNotNull(), F.col("stop_k").isNull() | (F.col("hit_k") < F.col("stop_k"))).when(m | F.col("stop_k").isNotNull(), False)
    last_net = (F.col("last.close") / F.col("entry") - 1) * 10_000 - cost_bps
    r = r.withColumn("first", before)
    net = F.when(c & ~F.col("ambiguous"), F.when(F.col("first"), F.col("level") * 100 - cost_bps).when(F.col("stop_k").isNotNull(), -F.col("stop_pct") * 100 - cost_bps).when(m, last_net))
    hit = F.when(c, F.when(F.col("hit_k").isNotNull(), True).when(m, False))
    return r.select("symbol", "event_ms", "level", "mature", "complete", hit.alias("hit"), F.col("first").alias("first_before_stop"), "ambiguous", net.alias("net_bps"),
                    F.greatest(F.lit(0.0), F.array_max(F.transform("path", gain))).alias("mfe_pct"), F.greatest(F.lit(0.0), F.array_max(F.transform("path", loss))).alias("mae_pct"))


def level_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key: records, hits, first-before-stop wins, ties and mean net of mature, complete windows."""
    ok = F.col("mature") & F.col("complete")
    f = F.col("first_before_stop")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("records"), F.count_if(~F.col("mature")).alias("pending"), F.count_if(F.col("mature") & ~F.col("complete")).alias("missing"), F.count_if(ok).alias("n"), F.count_if(ok & F.col("hit")).alias("hits"),
        F.count_if(ok & f.isNotNull()).alias("first_n"), F.count_if(ok & f).alias("first_wins"), F.count_if(ok & f.isNull()).alias("ambiguous"), F.avg(F.when(ok, F.col("net_bps"))).alias("mean_net"))


def stop_hold(events: DataFrame, horizon: int, stop_bps: Column, levels: tuple[float, ...]) -> DataFrame:
    """Hold to the last close of a whole window or to the stop (at the open if it opens beyond); for each level, was it
    touched before the stop's candle."""
    r = events.where(F.size("path") == horizon).withColumn("entry", F.col("path")[0].open).withColumn("stop", F.col("entry") * (1 - stop_bps / 10_000))
    r = r.withColumn("hit", first_of(F.col("path"), lambda x: x.low <= F.col("stop")))
    exit_ = F.when(F.col("hit").isNotNull(), F.when((F.col("hit.open") <= F.col("stop")) & (F.col("hit.k") > 1), F.col("hit.open")).otherwise(F.col("stop"))).otherwise(F.col("path")[horizon - 1].close)
    seen = F.filter("path", lambda x: F.col("hit").isNull() | (x.k < F.col("hit.k")))
    above = lambda v: lambda x: x.high >= F.col("entry") * (1 + v / 100)
    touch = {f"touched_{int(v)}": F.exists(seen, above(v)) for v in levels}
    return r.withColumns(touch).select("symbol", "event_ms", "entry", F.when(F.col("hit").isNotNull(), "STOP").otherwise("TIME").alias("reason"), ((exit_ / F.col("entry") - 1) * 10_000).alias("gross_bps"), *touch)


def two_sided(events: DataFrame, horizon: int, levels: tuple[float, ...], stop_pct: float, cost_bps: float) -> DataFrame:
    """LONG and SHORT labels of whole windows from the next open: each level touched, touched before the stop, and the close's net."""
    r = events.where(F.size("path") == horizon).withColumn("entry", F.col("path")[0].open).withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    up = F.col("side") > 0
    r = r.withColumn("stop_k", first_of(F.col("path"), _reached(~up, F.col("entry") * (1 - F.col("side") * stop_pct / 100))).k).withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    r = r.withColumn("hit_k", first_of(F.col("path"), _reached(up, F.col("entry") * (1 + F.col("side") * F.col("level") / 100))).k)
    net = F.log(F.col("path")[horizon - 1].close / F.col("entry")) * 10_000 * F.col("side") - cost_bps
    return r.select("symbol", "event_ms", "side", "level", F.col("hit_k").isNotNull().alias("touched"), F.coalesce(F.col("hit_k") < F.coalesce("stop_k", F.lit(horizon + 1)), F.lit(False)).alias("before_stop"), net.alias("close_net_bps"))


def open_status(events: DataFrame, deadline_ms: Column, data_end: Column) -> DataFrame:
    """PENDING while the data end before the deadline, UNKNOWN_DATA after; either way the place is kept to the deadline."""
    return events.select("symbol", "event_ms", F.when(data_end < deadline_ms, "PENDING").otherwise("UNKNOWN_DATA").alias("status"), deadline_ms.alias("reserved_until"))


def clock_events(bars: DataFrame, every: int, hours: tuple[int, ...], unit: int) -> DataFrame:
    """An unconditional baseline: every symbol's candles at fixed places of the period ``every`` (in ``unit``)."""
    at = F.floor(F.pmod("open_time_ms", F.lit(every)) / unit)
    return bars.where(at.isin(*hours)).select("symbol", F.col("open_time_ms").alias("event_ms"), F.col("close").alias("source"))


def first_of_period(events: DataFrame, period: int) -> DataFrame:
    """The first event of each symbol and period."""
    r = events.withColumn("period", F.floor(F.col("event_ms") / period).cast("long"))
    n = F.row_number().over(Window.partitionBy("symbol", "period").orderBy("event_ms"))
    return r.withColumn("_n", n).where("_n = 1").drop("_n")


def grid_entries(records: DataFrame, bars: DataFrame, now_ms: int, step: int, grids: tuple[int, ...], hold: int, levels: tuple[float, ...] = (2, 3, 5)) -> DataFrame:
    """Records (id, symbol, recorded_ms, stop_pct, cost_bps) entered at the first open of each grid (multiples of so many ms) after
    they were recorded and followed for ``hold`` steps; one row for each record, grid and level (percent above the entry).

    ``mature``: the whole hold is past at ``now_ms``. ``complete``: there is a candle for every step up to then, at least one; else
    all results are null. A level and the stop in one candle: which came first is unknown, so is the net. Before maturity a level
    that was not met is undecided unless the stop was. Candles whose close is not at the end of their step count as missing.
    """
    start = (F.floor(F.col("recorded_ms") / F.col("grid_ms")) + 1) * F.col("grid_ms")
    r = records.withColumn("grid_ms", F.explode(F.array(*[F.lit(g).cast("long") for g in grids]))).withColumn("entry_open_ms", start).withColumn("event_ms", F.col("entry_open_ms") - step)
    r = with_path(r, bars.where(F.col("close_time_ms") - F.col("open_time_ms") == step - 1), step, hold)
    end = F.col("entry_open_ms") + F.lit(hold * step)
    due = F.floor((F.least(end, F.lit(now_ms // step * step)) - F.col("entry_open_ms")) / step)
    r = r.withColumns({"mature": end <= now_ms, "_due": due}).withColumn("_seen", F.filter("path", lambda x: x.k <= F.col("_due")))
    r = r.withColumn("complete", (F.col("_due") > 0) & (F.size("_seen") == F.col("_due"))).withColumn("_seen", F.when(F.col("complete"), F.col("_seen")))
    r = r.withColumns({"entry_price": F.col("_seen")[0].open, "_last": F.try_element_at("_seen", F.lit(-1)).close})
    fallen = lambda x: (1 - x.low / F.col("entry_price")) * 100 >= F.col("stop_pct") - 1e-9
    risen = lambda x: (x.high / F.col("entry_price") - 1) * 100 >= F.col("level") - 1e-9
    r = r.withColumn("_stop", first_of(F.col("_seen"), fallen).k).withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels]))).withColumn("_hit", first_of(F.col("_seen"), risen).k)
    hit, stop, over = F.col("_hit"), F.col("_stop"), F.col("mature") & F.col("complete")
    both = F.coalesce(hit == stop, F.lit(False))
    first = F.when(both, None).when(hit.isNotNull(), stop.isNull() | (hit < stop)).when(over | stop.isNotNull(), F.lit(False))
    gross = F.when(first, F.col("level") * 100).when(stop.isNotNull(), -F.col("stop_pct") * 100).when(over, (F.col("_last") / F.col("entry_price") - 1) * 10_000)
    return r.select("id", "grid_ms", "entry_open_ms", "mature", "complete", "entry_price", "level", F.when(hit.isNotNull(), True).when(over, False).alias("hit"), first.alias("first_before_stop"), F.when(~both, gross - F.col("cost_bps")).alias("net_bps"))
