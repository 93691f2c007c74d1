"""Registered rules, studies and streams with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.scalars import series
from candela.operators import rules, studies
from candela.plans.catalog import BARS_1D, BARS_1H, DAY, HOUR, TRADES, W, query, trades_1d
from candela.sources import bars as src
from candela.streaming import candles as live

#: Columns that the rules read.
RULED = BARS_1D + f""",
r0 AS (SELECT *, CASE WHEN count(*) OVER b >= 20 THEN (volume - avg(volume) OVER b) / nullif(stddev_pop(volume) OVER b, 0) END AS vz, CASE WHEN count(*) OVER b >= 20 THEN (close - avg(close) OVER b) / nullif(stddev_pop(close) OVER b, 0) END AS cz,
  CASE WHEN count(*) OVER p = 12 THEN max(high) OVER p END AS prior_high, close / lag(close, 3) OVER w - 1 AS fall FROM bars
  WINDOW w AS {W}, b AS (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), p AS (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
r1 AS (SELECT *, lag(close) OVER w AS pc, lag(prior_high) OVER w AS ph, lag(cz) OVER w AS pz, lag(fall) OVER w AS pfall, lag(high) OVER w AS phigh FROM r0 WINDOW w AS {W})"""


@query(f"""WITH {RULED} SELECT symbol, open_time_ms, 'VOLUME' AS rule FROM r1 WHERE vz >= 1 AND close > open UNION ALL SELECT symbol, open_time_ms, 'CROSS' FROM r1 WHERE close > prior_high AND pc <= ph AND vz >= 0
UNION ALL SELECT symbol, open_time_ms, 'SNAP_BACK' FROM r1 WHERE pz < -2 AND cz >= -2 UNION ALL SELECT symbol, open_time_ms, 'RECLAIM' FROM r1 WHERE pfall <= -0.1 AND close > phigh AND vz >= 0""")
def rule_registry(spark, sf):
    return rules.rule_hits(src.bars_1d(spark, sf))


@query(f"""WITH {BARS_1D}, s AS (SELECT *, open_time_ms - open_time_ms % {28 * DAY} AS bucket_ms FROM bars), e AS (SELECT symbol, bucket_ms, min(low) AS lo, max(high) AS hi FROM s GROUP BY ALL HAVING max(high) > min(low)),
x AS (SELECT s.*, lo, (hi - lo) / 40 AS width, least(floor((low - lo) / ((hi - lo) / 40)), 39)::INT AS r0, least(floor((high - lo) / ((hi - lo) / 40)), 39)::INT AS r1 FROM s JOIN e USING (symbol, bucket_ms)),
y AS (SELECT *, unnest(generate_series(r0, r1))::INT AS "row" FROM x),
z AS (SELECT symbol, bucket_ms, "row", any_value(lo + ("row" + 0.5) * width) AS poc, round(sum(volume * CASE WHEN high > low THEN greatest(least(high, lo + "row" * width + width) - greatest(low, lo + "row" * width), 0) / (high - low) ELSE 1 END), 6) AS v FROM y GROUP BY ALL)
SELECT symbol, bucket_ms, "row", round(poc, 6) AS poc, v AS volume FROM z QUALIFY row_number() OVER (PARTITION BY symbol, bucket_ms ORDER BY v DESC, "row") = 1""")
def point_of_control(spark, sf):
    return rules.volume_profile(src.bars_1d(spark, sf), 28 * DAY).withColumn("poc", F.round("poc", 6))


@query(f"""WITH {BARS_1D}, g AS (SELECT symbol, CASE WHEN coalesce(volume < 50, TRUE) THEN 'liquidity' WHEN coalesce((high - low) / close > 0.9, TRUE) THEN 'range' WHEN coalesce(close <= lag(close) OVER {W}, TRUE) THEN 'direction' ELSE 'passed' END AS reason FROM bars)
SELECT symbol, reason, count(*) AS n FROM g GROUP BY ALL""")
def gate_funnel(spark, sf):
    """Counts of candles by the first gate that they fail."""
    reason = rules.first_reason(("liquidity", F.col("volume") >= 50), ("range", (F.col("high") - F.col("low")) / F.col("close") <= 0.9), ("direction", F.col("close") > F.lag("close").over(series())))
    return src.bars_1d(spark, sf).select("symbol", reason.alias("reason")).groupBy("symbol", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {BARS_1D}, r AS (SELECT symbol, open_time_ms, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), q AS (SELECT *, greatest(500, n // 2) AS e, greatest(120, n // 10) AS size FROM r),
f AS (SELECT *, CAST(floor((n - 60 - e - size - 24) / size) AS BIGINT) + 1 AS folds FROM q), x AS (SELECT *, unnest(generate_series(0, folds - 1)) AS fold FROM f WHERE folds > 0),
y AS (SELECT symbol, open_time_ms, fold, CASE WHEN i < e + fold * size THEN 'train' WHEN i >= e + fold * size + 12 AND i < e + fold * size + 12 + size THEN 'calibration' WHEN i >= e + fold * size + size + 24 AND i < e + fold * size + 2 * size + 24 THEN 'test' END AS role FROM x)
SELECT symbol, fold, role, count(*) AS "rows", min(open_time_ms) AS first_ms, max(open_time_ms) AS last_ms FROM y WHERE role IS NOT NULL GROUP BY ALL""")
def walk_forward_folds(spark, sf):
    return studies.walk_forward(src.bars_1d(spark, sf), embargo=12)


@query(f"""WITH {BARS_1D}, s AS (SELECT *, avg(close) OVER p AS m, stddev_pop(close) OVER p AS d, avg(volume) OVER p AS mv, stddev_pop(volume) OVER p AS dv FROM bars WINDOW p AS (PARTITION BY symbol))
SELECT symbol, open_time_ms, round(greatest(-8, least(8, (close - m) / greatest(d, 1e-9))), 6) AS close, round(greatest(-8, least(8, (volume - mv) / greatest(dv, 1e-9))), 6) AS volume FROM s""")
def standardiser(spark, sf):
    r = studies.standardised(src.bars_1d(spark, sf).select("symbol", "open_time_ms", "close", "volume"), ("close", "volume"))
    return r.withColumns({c: F.round(c, 6) for c in ("close", "volume")})


@query(f"""WITH {BARS_1D}, r AS (SELECT symbol, (close - low) / nullif(high - low, 0) AS p, CAST(lead(close) OVER {W} > close AS INT) AS hit FROM bars)
SELECT symbol, (CASE WHEN p >= 0.4 THEN 1 ELSE 0 END + CASE WHEN p >= 0.6 THEN 1 ELSE 0 END + CASE WHEN p >= 0.8 THEN 1 ELSE 0 END)::INT AS bin, count(*) AS n, round(avg(p), 8) AS predicted, round(avg(hit), 8) AS observed FROM r WHERE p IS NOT NULL AND hit IS NOT NULL GROUP BY ALL""")
def calibration(spark, sf):
    """The close's place in its candle as a prediction of a higher next close."""
    p = (F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    return studies.calibration_bins(src.bars_1d(spark, sf), p, F.lead("close").over(series()) > F.col("close"))


@query(f"""WITH {TRADES}, g AS (SELECT CAST(c AS DOUBLE) AS cost, count(*) AS trades, count(DISTINCT symbol) AS symbols, count(DISTINCT event_ms // 86400000) AS days, round(avg(gross_bps - c), 6) AS mean_net, count(*) FILTER (gross_bps - c > 0) AS wins
  FROM trades, (VALUES (12), (30), (50), (70)) k(c) WHERE gross_bps IS NOT NULL GROUP BY c) SELECT *, trades >= 100 AND days >= 15 AND symbols >= 2 AND mean_net > 0 AS gate FROM g""")
def cost_stress(spark, sf):
    return studies.cost_stress(trades_1d(spark, sf))


@query(f"""WITH {BARS_1D}, r AS (SELECT CASE WHEN close > open THEN 'up' ELSE 'down' END AS p, CASE WHEN volume >= 500 THEN 'high' ELSE 'low' END AS v, (lead(close) OVER {W} / close - 1) * 10000 AS next FROM bars)
SELECT p, v, count(*) AS n, round(quantile_cont(next, 0.1), 6) AS p10, round(quantile_cont(next, 0.5), 6) AS p50, round(quantile_cont(next, 0.9), 6) AS p90 FROM r WHERE next IS NOT NULL GROUP BY GROUPING SETS ((p, v), (p), ())""")
def scenario_table(spark, sf):
    up, busy = F.when(F.col("close") > F.col("open"), "up").otherwise("down"), F.when(F.col("volume") >= 500, "high").otherwise("low")
    r = src.bars_1d(spark, sf).select(up.alias("p"), busy.alias("v"), ((F.lead("close").over(series()) / F.col("close") - 1) * 10_000).alias("next"))
    return studies.scenario_table(r, "next", "p", "v")


@query(f"""WITH {TRADES}, g AS (SELECT symbol, event_ms // {7 * DAY} AS week, count(*) AS trades, sum(net_bps) AS net FROM trades WHERE net_bps IS NOT NULL GROUP BY ALL), a AS (SELECT symbol, unnest(generate_series(min(week), max(week))) AS week FROM g GROUP BY symbol)
SELECT symbol, week, coalesce(trades, 0) AS trades, round(coalesce(net, 0), 5) AS net FROM a LEFT JOIN g USING (symbol, week)""")
def weekly_slices(spark, sf):
    return studies.weekly(trades_1d(spark, sf))


@query(f"""WITH {TRADES}, g AS (SELECT symbol, event_ms // {DAY} AS day, count(*) AS trades, sum(net_bps) AS net FROM trades WHERE net_bps IS NOT NULL GROUP BY ALL), a AS (SELECT symbol, unnest(generate_series(min(day), max(day))) AS day FROM g GROUP BY symbol)
SELECT symbol, day, coalesce(trades, 0) AS trades, round(coalesce(net, 0), 5) AS net FROM a LEFT JOIN g USING (symbol, day)""")
def daily_slices(spark, sf):
    return studies.slices(trades_1d(spark, sf), 1, "day")


@query(f"""WITH {BARS_1D}, s AS (SELECT symbol, open_time_ms, sum(volume) OVER (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS s, row_number() OVER {W} AS rn FROM bars),
m AS (SELECT a.symbol, a.rn, quantile_cont(b.s, 0.5) AS med FROM s a JOIN s b ON b.symbol = a.symbol AND b.rn < a.rn AND b.rn >= a.rn - 288 AND (a.rn - b.rn) % 12 = 0 WHERE a.rn >= 300 GROUP BY ALL)
SELECT symbol, open_time_ms, s / nullif(med, 0) AS ratio FROM s LEFT JOIN m USING (symbol, rn)""")
def disjoint_volume_ratio(spark, sf):
    return studies.disjoint_sums_ratio(src.bars_1d(spark, sf))


@query(f"""WITH {TRADES}, h AS (SELECT symbol, CASE WHEN event_ms % {5 * DAY} = 0 THEN 'X' ELSE 'Y' END AS regime, CASE WHEN net_bps > 0 THEN 1 ELSE 0 END AS win, event_ms FROM trades WHERE net_bps IS NOT NULL),
a AS (SELECT symbol, regime, count(*) AS n0, avg(win) AS p0 FROM h GROUP BY ALL), b AS (SELECT regime, count(*) AS n1, avg(win) AS p1 FROM h GROUP BY ALL), c AS (SELECT count(*) AS n2, avg(win) AS p2 FROM h)
SELECT i.symbol, i.event_ms, i.regime, (CASE WHEN n0 >= 10 THEN 0 WHEN n1 >= 10 THEN 1 ELSE 2 END)::INT AS level, CASE WHEN n0 >= 10 THEN n0 WHEN n1 >= 10 THEN n1 ELSE n2 END AS n, round(CASE WHEN n0 >= 10 THEN p0 WHEN n1 >= 10 THEN p1 ELSE p2 END, 9) AS rate
FROM h i LEFT JOIN a USING (symbol, regime) LEFT JOIN b USING (regime) CROSS JOIN c""")
def cohort_fallback(spark, sf):
    regime = F.when(F.col("event_ms") % (5 * DAY) == 0, "X").otherwise("Y").alias("regime")
    h = trades_1d(spark, sf).where("net_bps is not null").select("symbol", "event_ms", regime, (F.col("net_bps") > 0).cast("int").alias("win"))
    return studies.history_with_fallback(h.select("symbol", "event_ms", "regime"), h)


@query(f"""WITH {BARS_1D}, f AS (SELECT symbol, close, max(high) OVER a AS top, min(low) OVER a AS bottom, count(*) OVER a AS n FROM bars WINDOW a AS (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))
SELECT symbol, CAST(l AS DOUBLE) AS level, count(*) AS n, CAST(sum(CAST(top >= close * (1 + l / 100.0) AS INT)) AS BIGINT) AS up, CAST(sum(CAST(bottom <= close * (1 - l / 100.0) AS INT)) AS BIGINT) AS down FROM f, (VALUES (2), (3), (5)) k(l) WHERE n = 10 GROUP BY symbol, l""")
def touch_levels(spark, sf):
    return studies.multi_touch(src.bars_1d(spark, sf), 10)


@query(f"WITH {TRADES} SELECT symbol, event_ms, reason FROM trades WHERE event_ms % {3 * DAY} <> 0")
def ledger_append(spark, sf):
    """A replay of all trades against a ledger that has a third of them, each offered twice."""
    t = trades_1d(spark, sf).select("symbol", "event_ms", "reason")
    return studies.append_new(t.where(F.col("event_ms") % (3 * DAY) == 0), t.unionByName(t), "symbol", "event_ms")


@query(f"""WITH {BARS_1H}, e AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT min(open_time_ms) AS a, max(open_time_ms) AS b FROM bars GROUP BY symbol)) SELECT symbol, count(*) AS n, min(open_time_ms) AS first_ms, max(open_time_ms) AS last_ms FROM bars, e WHERE open_time_ms BETWEEN a AND b GROUP BY symbol""")
def common_window(spark, sf):
    return studies.common_window(src.bars_1h(spark, sf)).groupBy("symbol").agg(F.count("*").alias("n"), F.min("open_time_ms").alias("first_ms"), F.max("open_time_ms").alias("last_ms"))


@query(f"""WITH {BARS_1H}, o AS (SELECT symbol, open_time_ms, open_time_ms // {DAY} AS day FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, open_time_ms // {DAY} ORDER BY trade_count DESC, open_time_ms) = 1)
SELECT symbol, day, row_number() OVER (PARTITION BY day ORDER BY (SELECT trade_count FROM bars b WHERE b.symbol = o.symbol AND b.open_time_ms = o.open_time_ms) DESC, symbol)::INT AS place, open_time_ms FROM o QUALIFY place <= 3""")
def daily_quota(spark, sf):
    return studies.daily_quota(src.bars_1h(spark, sf), "trade_count", 3)


@query(f"""WITH {BARS_1H} SELECT symbol, open_time_ms, open, high, low, close, trade_count FROM bars WHERE open_time_ms + {HOUR} <= (SELECT epoch_ms(date_trunc('milliseconds', max(ts))) - {2 * HOUR} FROM events)""")
def streamed_bars(spark, sf):
    """Hourly candles from a stream of events: those that the watermark has closed."""
    return live.finished(spark, live.tumbling_bars(live.events(spark, sf)), "streamed-bars")


@query()
def streamed_regime(spark, sf):
    """A confirmed regime for each symbol from a stream of hourly candles, kept in state."""
    path = live.stored_bars(spark, src.bars_1h(spark, sf))
    return live.finished(spark, live.regimes(live.bar_stream(spark, path)), "streamed-regime")
