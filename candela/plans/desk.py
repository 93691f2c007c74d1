"""Registered desk queries with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from candela.operators import desk as dk
from candela.operators import ledgers as lg
from candela.operators import market as mk
from candela.operators import outcomes as oc
from candela.operators import summaries as sm
from candela.operators import sweeps as sw
from candela.plans.catalog import BARS_1D, DAY, TRADES, query, rounded, trades_1d
from candela.plans.ledgers import FORECAST, LEDGER, NOW, forecast_frame, newest
from candela.plans.market import BENCH, CALM, IND, RULES, P, _ewm, calm, lag, study_frame
from candela.plans.outcomes import EV, H, base_events, thin, with_paths
from candela.sources import bars as src
from candela.sources.ledger import signals, strategy


@query("""WITH p AS (SELECT p_partkey AS symbol, p_retailprice AS bid, p_retailprice * (1 + (p_size - 5) / 10000.0) AS ask FROM part) SELECT p.symbol, round((ask - bid) / ((ask + bid) / 2) * 10000, 6) AS spread_bps, CASE WHEN symbol % 7 <> 0 THEN bid END AS mark, CASE WHEN symbol % 7 <> 0 THEN round((symbol % 11 - 5) / 10000.0 * 10000, 6) END AS funding_bps, CASE WHEN symbol % 5 <> 0 THEN CAST(symbol * 1000 AS DOUBLE) END AS quote_volume FROM p WHERE ask >= bid""")
def snapshots(spark, sf):
    """Market snapshots from prices, premium and volume of parts; crossed quotes go."""
    k = F.col("p_partkey")
    p = src.read(spark, sf, "part")
    prices = p.select(k.alias("symbol"), F.col("p_retailprice").alias("bid"), (F.col("p_retailprice") * (1 + (F.col("p_size") - 5) / 10_000.0)).alias("ask"))
    premium = p.where(k % 7 != 0).select(k.alias("symbol"), F.col("p_retailprice").alias("mark"), ((k % 11 - 5) / 10_000.0).alias("funding"))
    r = dk.snapshots(prices, premium, p.where(k % 5 != 0).select(k.alias("symbol"), (k * 1000.0).alias("quote_volume")))
    return rounded(r, 6, "spread_bps", "funding_bps")


@query(f"""WITH {EV}, e AS (SELECT ev.* EXCLUDE (source), CASE WHEN event_ms % {5 * DAY} = 0 THEN source + 1e-6 ELSE source END AS source FROM ev), c AS (SELECT e.symbol, e.event_ms, e.source, count(t.close) AS n, max(t.close) AS seen FROM e LEFT JOIN tb t ON t.symbol = e.symbol AND t.open_time_ms = e.event_ms GROUP BY ALL),
p AS (SELECT symbol, event_ms, count(*) AS k FROM pa GROUP BY ALL) SELECT symbol, event_ms, CASE WHEN n <> 1 THEN 'no_source' WHEN abs(seen - source) > 1e-9 THEN 'source_price' WHEN coalesce(k, 0) <> {H} THEN 'rows' ELSE 'ok' END AS status FROM c LEFT JOIN p USING (symbol, event_ms)""")
def event_windows(spark, sf):
    """Event windows checked against the candles: source, price, rows, ranges."""
    e = with_paths(spark, sf).withColumn("source", F.when(F.col("event_ms") % (5 * DAY) == 0, F.col("source") + 1e-6).otherwise(F.col("source")))
    return dk.window_status(e, thin(spark, sf), H)


@query(f"""WITH {LEDGER}, n AS (SELECT symbol, max(bar_ms) AS close_ms FROM ledger WHERE bar_ms <= {NOW + DAY} GROUP BY symbol), f AS (SELECT *, {NOW} - close_ms <= {2 * DAY} AND close_ms <= {NOW} AS fresh FROM n)
SELECT symbol, close_ms, fresh, round((SELECT avg(fresh::INT) FROM f), 9) AS coverage, fresh AND close_ms = (SELECT max(close_ms) FROM f WHERE fresh) AS kept FROM f""")
def scan_freshness(spark, sf):
    n = signals(spark, sf).where(F.col("bar_ms") <= NOW + DAY).groupBy("symbol").agg(F.max("bar_ms").alias("close_ms"))
    return rounded(dk.fresh(n, NOW, 2 * DAY), 9, "coverage")


@query(f"""WITH {LEDGER}, r AS (SELECT id, id % 4 <> 0 AS gate, 0.5 + (id % 10) / 50.0 AS confidence, {NOW} - (id % 12) * {DAY} AS trained_ms, {NOW} + (id % 7) * 50000 - 50000 AS target FROM ledger),
x AS (SELECT id, list_filter([CASE WHEN NOT gate THEN 'gate' END, CASE WHEN confidence < 0.55 THEN 'confidence' END, CASE WHEN {NOW} - trained_ms > {8 * DAY} THEN 'stale' END, CASE WHEN target - {NOW} <= 0 THEN 'closed' WHEN (target - {NOW}) / 300000.0 < 0.6 THEN 'timing' END], lambda v: v IS NOT NULL) AS rs FROM r) SELECT id, array_to_string(rs, ',') AS reasons, len(rs) = 0 AS eligible FROM x""")
def model_eligibility(spark, sf):
    """Reasons against sending a scored row: gate, confidence, model age, timing."""
    u = F.col("id")
    r = signals(spark, sf).select(u, (u % 4 != 0).alias("gate"), (0.5 + (u % 10) / 50.0).alias("confidence"), (F.lit(NOW) - (u % 12) * DAY).alias("trained_ms"), (F.lit(NOW) + (u % 7) * 50_000 - 50_000).alias("target_close_ms"), F.lit(300_000).alias("step_ms"))
    return dk.eligibility(r, NOW).select("id", "reasons", "eligible")


OIC = BENCH + f""",
oi AS (SELECT (o_orderkey % 2)::INT AS series, epoch_ms(o_orderdate) AS t, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY ALL), oc AS (SELECT series, t, v / nullif(lag(v, 12) OVER (PARTITION BY series ORDER BY t), 0) - 1 AS change, count(*) OVER (PARTITION BY series ORDER BY t RANGE BETWEEN {12 * DAY} PRECEDING AND CURRENT ROW) AS n FROM oi),
ol AS (SELECT series, k AS lag, t + k * {DAY} AS open_time_ms, CASE WHEN n = 13 THEN change END AS change FROM oc, (VALUES (1), (2), (3)) v(k)),
br AS (SELECT symbol, open_time_ms, ret12 FROM ind WHERE symbol IN ('A', 'R')),
hit AS (SELECT symbol, open_time_ms, quote_volume FROM wide WHERE {RULES['TREND_BREAKOUT_12']}),
oj AS (SELECT hit.*, k AS lag, a.change AS c0, b.change AS c1, x.ret12 AS r0, y.ret12 AS r1 FROM hit CROSS JOIN (VALUES (1), (2), (3)) v(k) LEFT JOIN ol a ON a.series = 0 AND a.lag = k AND a.open_time_ms = hit.open_time_ms LEFT JOIN ol b ON b.series = 1 AND b.lag = k AND b.open_time_ms = hit.open_time_ms LEFT JOIN br x ON x.symbol = 'A' AND x.open_time_ms = hit.open_time_ms LEFT JOIN br y ON y.symbol = 'R' AND y.open_time_ms = hit.open_time_ms),
orr AS (SELECT *, CASE WHEN c0 IS NULL OR c1 IS NULL OR r0 IS NULL OR r1 IS NULL THEN 'missing_context' WHEN quote_volume < 150000 THEN 'liquidity' WHEN r0 <= 0 OR r1 <= 0 THEN 'not_rising' WHEN NOT (least(c0, c1) >= 0 AND greatest(c0, c1) >= 0.005) THEN 'not_confirmed' ELSE 'confirmed' END AS reason FROM oj)"""


@query(f"""WITH RECURSIVE {OIC}, fw AS (SELECT symbol, open_time_ms, close, max(high) OVER n AS top, count(*) OVER n AS whole FROM bars WINDOW n AS (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING))
SELECT lag::INT AS lag, reason, count(*) AS n, count(*) FILTER (whole = 12) AS windows, count(*) FILTER (whole = 12 AND top >= close * 1.01) AS touched_1, count(*) FILTER (whole = 12 AND top >= close * 1.02) AS touched_2 FROM orr JOIN fw USING (symbol, open_time_ms) GROUP BY ALL""")
def oi_rejections(spark, sf):
    """Trend breakouts by the first reason against them under three lags of open interest, and what they touched later."""
    o = src.read(spark, sf, "orders").groupBy((F.col("o_orderkey") % 2).cast("int").alias("series"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("t")).agg(F.count("*").cast("double").alias("v"))
    c = dk.oi_changes(o, DAY, (1, 2, 3))
    f = study_frame(spark, sf)
    w = mk.series().rowsBetween(1, 12)
    f = f.withColumns({"top": F.max("high").over(w), "whole": F.count("*").over(w)})
    ret = f.where("symbol in ('A', 'R')").groupBy("open_time_ms").agg(F.max(F.when(F.col("symbol") == "A", F.col("ret12"))).alias("r0"), F.max(F.when(F.col("symbol") == "R", F.col("ret12"))).alias("r1"))
    hit = f.where(RULES["TREND_BREAKOUT_12"]).select("symbol", "open_time_ms", "close", "quote_volume", "top", "whole", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("lag"))
    for s in (0, 1):
        hit = hit.join(c.where(F.col("series") == s).select("lag", "open_time_ms", F.col("change").alias(f"c{s}")), ["lag", "open_time_ms"], "left")
    r = hit.join(ret, "open_time_ms", "left").withColumn("reason", dk.oi_reason(F.col("quote_volume") >= 150_000))
    touched = lambda p: F.count_if((F.col("whole") == 12) & (F.col("top") >= F.col("close") * (1 + p / 100)))
    return r.groupBy("lag", "reason").agg(F.count("*").alias("n"), F.count_if(F.col("whole") == 12).alias("windows"), touched(1).alias("touched_1"), touched(2).alias("touched_2"))


@query(f"""WITH {LEDGER}, n AS (SELECT 'ledger' AS name, max(bar_ms) AS m FROM ledger WHERE bar_ms <= {NOW} UNION ALL SELECT 'open', max(bar_ms) FROM ledger WHERE status IS NULL AND bar_ms <= {NOW} - {9 * DAY} UNION ALL SELECT 'old', max(bar_ms) FROM ledger WHERE bar_ms < 800000000000 UNION ALL SELECT 'none', max(bar_ms) FROM ledger WHERE bar_ms < 0)
SELECT 'stale:' || name AS code, {NOW} - m AS age_ms FROM n WHERE (m IS NULL OR {NOW} - m > {3 * DAY}) AND name <> 'old'""")
def health_incidents(spark, sf):
    """Stale and empty tables as incidents, without those told within six hours."""
    l = signals(spark, sf)
    newest_of = lambda name, cond: l.where(cond).agg(F.max("bar_ms").alias("newest_ms")).select(F.lit(name).alias("name"), "newest_ms")
    n = newest_of("ledger", F.col("bar_ms") <= NOW).unionByName(newest_of("open", F.col("status").isNull() & (F.col("bar_ms") <= NOW - 9 * DAY))).unionByName(newest_of("old", F.col("bar_ms") < 800_000_000_000)).unionByName(newest_of("none", F.col("bar_ms") < 0))
    found = dk.stale_tables(n, {k: 3 * DAY for k in ("ledger", "open", "old", "none")}, NOW)
    sent = spark.createDataFrame([("stale:old", NOW - 3_600_000), ("stale:open", NOW - 8 * 3_600_000)], "code string, sent_ms long")
    return dk.due_incidents(found, sent, NOW, 6 * 3_600_000)


@query(f"""WITH {LEDGER} SELECT id FROM ledger WHERE notified AND symbol LIKE '%1%' AND list_contains(families, 'F2') AND direction = 'LONG' AND status IS NULL AND CAST(timezone('Europe/Istanbul', make_timestamptz(bar_ms * 1000)) AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2000-06-30'""")
def signal_explorer(spark, sf):
    """A conjunctive filter with a local date range."""
    return dk.explore(signals(spark, sf), "Europe/Istanbul", audience="notified", symbol="1", family="F2", direction="LONG", regime=None, status="open", since="1996-01-01", until="2000-06-30").select("id")


@query(f"""WITH {LEDGER}, s AS (SELECT symbol, max_by(quote_volume, {{'b': bar_ms, 'i': id}}) AS volume FROM ledger WHERE id % 2 = 0 AND symbol <> 'C7' GROUP BY symbol), g AS (SELECT max_by(regime, {{'b': bar_ms, 'i': id}}) AS now_regime FROM ledger) SELECT id, volume, now_regime, row_number() OVER (PARTITION BY bar_ms // {DAY} ORDER BY bar_ms, id)::INT AS place FROM ledger LEFT JOIN s USING (symbol) CROSS JOIN g""")
def enriched_signals(spark, sf):
    """Signals with their symbol's snapshot, the market's one-row regime and their place in the day."""
    l = signals(spark, sf)
    snap = l.where("id % 2 = 0 and symbol <> 'C7'").groupBy("symbol").agg(F.max_by("quote_volume", F.struct("bar_ms", "id")).alias("volume"))
    now = l.agg(F.max_by("regime", F.struct("bar_ms", "id")).alias("now_regime"))
    r = l.join(snap, "symbol", "left").crossJoin(F.broadcast(now))  # one row
    return r.select("id", "volume", "now_regime", F.row_number().over(Window.partitionBy(F.floor(F.col("bar_ms") / DAY)).orderBy("bar_ms", "id")).alias("place"))


GRID = [(t, s, h) for t in (1.0, 2.0) for s in (1.0, 1.5) for h in (6, 12)]


@query(f"""WITH {EV}, n AS (SELECT symbol, event_ms FROM pa GROUP BY ALL HAVING count(*) = {H}), w AS (SELECT pa.*, first(open) OVER (PARTITION BY symbol, event_ms ORDER BY k) AS entry FROM pa JOIN n USING (symbol, event_ms)), g(target, stop, hold) AS (VALUES {', '.join(map(str, GRID))}),
x AS (SELECT symbol, event_ms, target, stop, hold, any_value(entry) AS entry, arg_min(CASE WHEN low <= entry * (1 - stop / 100) THEN entry * (1 - stop / 100) ELSE entry * (1 + target / 100) END, k) FILTER (low <= entry * (1 - stop / 100) OR high >= entry * (1 + target / 100)) AS hp, max(close) FILTER (k = hold) AS lc FROM w JOIN g ON k <= hold GROUP BY ALL)
SELECT CAST(target AS DOUBLE) AS target, CAST(stop AS DOUBLE) AS stop, hold, count(*) AS trades, count(*) FILTER ((coalesce(hp, lc) / entry - 1) * 10000 > 0) AS wins, round(avg((coalesce(hp, lc) / entry - 1) * 10000), 6) AS mean_gross FROM x GROUP BY ALL""")
def bracket_grid(spark, sf):
    """The same events against every cell of a parameter grid."""
    grid = spark.createDataFrame(GRID, "target double, stop double, hold int")
    return rounded(dk.bracket_grid(with_paths(spark, sf), grid, H), 6, "mean_gross")


@query(f"""WITH {EV}, n AS (SELECT symbol, event_ms FROM pa GROUP BY ALL HAVING count(*) = {H}), w AS (SELECT symbol, event_ms, max(open) FILTER (k = 1) AS e1, max(open) FILTER (k = 2) AS e2, max(close) FILTER (k = 6) AS c6, max(close) FILTER (k = 12) AS c12 FROM pa JOIN n USING (symbol, event_ms) GROUP BY ALL)
SELECT symbol, event_ms, round((c6 / e1 - 1) * 10000, 6) AS first_bps, round((c6 / e2 - 1) * 10000, 6) AS second_bps FROM w""")
def entry_pairs(spark, sf):
    """Two measurements of the same record, by the first and by the second candle's open, where both are complete."""
    p = with_paths(spark, sf).where(F.size("path") == H)
    one = lambda k, name: p.select("symbol", "event_ms", ((F.col("path")[5].close / F.col("path")[k].open - 1) * 10_000).alias(name))
    return rounded(one(0, "first_bps").join(one(1, "second_bps"), ["symbol", "event_ms"]), 6, "first_bps", "second_bps")


@query(f"""WITH {LEDGER}, s AS (SELECT direction AS side, c AS cost, gross - 5 * (c / 10) - CASE WHEN status = 'STOP' THEN 3 ELSE 0 END AS net FROM ledger, (VALUES (12.0), (30.0), (50.0)) v(c) WHERE status IS NOT NULL) SELECT side, CAST(cost AS DOUBLE) AS cost, count(*) AS n, round(avg(net), 6) AS mean_net, count(*) FILTER (net > 0) AS wins FROM s GROUP BY ALL""")
def stress_by_side(spark, sf):
    """Gross rebuilt from net, costs and slippage taken again, a haircut on stops; by cost and side."""
    r = signals(spark, sf).where("status is not null").withColumn("cost_bps", F.explode(F.array(*[F.lit(c) for c in (12.0, 30.0, 50.0)])))
    net = F.col("gross") - 5 * (F.col("cost_bps") / 10) - F.when(F.col("status") == "STOP", 3).otherwise(0)
    return rounded(r.groupBy(F.col("direction").alias("side"), F.col("cost_bps").alias("cost")).agg(F.count("*").alias("n"), F.avg(net).alias("mean_net"), F.count_if(net > 0).alias("wins")), 6, "mean_net")


@query(f"""WITH {LEDGER} SELECT count(*) AS records, count(*) FILTER (notified) AS notified, count(status) AS settled, count(*) FILTER (status = 'TARGET') AS targets, count(*) FILTER (status IN ('TARGET', 'STOP')) AS decided, round(count(*) FILTER (status = 'TARGET') / count(*) FILTER (status IN ('TARGET', 'STOP')), 9) AS target_first, {', '.join(f'count(*) FILTER (gross >= {k * 50}) AS level_{k}' for k in (2, 3, 5))} FROM ledger""")
def dashboard_counts(spark, sf):
    """Summary counts, targets before stops, and level counts."""
    s = F.col("status")
    r = signals(spark, sf).agg(F.count("*").alias("records"), F.count_if("notified").alias("notified"), F.count(s).alias("settled"), F.count_if(s == "TARGET").alias("targets"), F.count_if(s.isin("TARGET", "STOP")).alias("decided"), (F.count_if(s == "TARGET") / F.nullif(F.count_if(s.isin("TARGET", "STOP")), F.lit(0))).alias("target_first"), *[F.count_if(F.col("gross") >= k * 50).alias(f"level_{k}") for k in (2, 3, 5)])
    return rounded(r, 9, "target_first")


@query(f"""WITH RECURSIVE {LEDGER}, r AS (SELECT id, symbol || ':' || strategy AS key, bar_ms AS t FROM ledger), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, id) AS k FROM r), d AS (SELECT key, k, id, t, t AS sent, TRUE AS ok FROM o WHERE k = 1 UNION ALL SELECT o.key, o.k, o.id, o.t, CASE WHEN o.t >= d.sent + {20 * DAY} THEN o.t ELSE d.sent END, o.t >= d.sent + {20 * DAY} FROM d JOIN o ON o.key = d.key AND o.k = d.k + 1)
SELECT id FROM d WHERE ok""")
def realert_spacing(spark, sf):
    """Signals of one symbol and strategy at least twenty days after the last that was sent; of those at one time, the smallest id."""
    r = signals(spark, sf).select("id", F.concat_ws(":", "symbol", "strategy").alias("key"), F.col("bar_ms").alias("t")).withColumn("until", F.col("t") + F.lit(20 * DAY).cast("long"))
    return dk.spaced(r, "key", "t", "until", "id").select("id")


@query(f"""WITH RECURSIVE {TRADES}, o AS (SELECT symbol, event_ms, held, row_number() OVER (PARTITION BY symbol ORDER BY event_ms) AS k FROM trades WHERE net_bps IS NOT NULL), d AS (SELECT symbol, k, event_ms, event_ms + held * {DAY} AS free, TRUE AS ok FROM o WHERE k = 1 UNION ALL SELECT o.symbol, o.k, o.event_ms, CASE WHEN o.event_ms >= d.free THEN o.event_ms + o.held * {DAY} ELSE d.free END, o.event_ms >= d.free FROM d JOIN o ON o.symbol = d.symbol AND o.k = d.k + 1)
SELECT symbol, event_ms FROM d WHERE ok""")
def accepted_trades(spark, sf):
    """Trades that begin at or after the exit of the last accepted one of their symbol."""
    t = trades_1d(spark, sf).where("net_bps is not null").select("symbol", "event_ms", (F.col("event_ms") + F.col("held") * F.lit(DAY).cast("long")).alias("until"))
    return dk.spaced(t, "symbol", "event_ms", "until").select("symbol", "event_ms")


@query(f"""WITH RECURSIVE {CALM}, a AS (SELECT *, greatest(high - low, abs(high - {lag('close', 1)}), abs(low - {lag('close', 1)})) AS tr, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) AS rn FROM bars), b AS (SELECT *, CASE WHEN rn = 14 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) WHEN rn > 14 THEN tr END AS x FROM a),
{_ewm('sa', 'b', {'y': ('x', '(1.0 / 14)')})} SELECT symbol, open_time_ms, round(y, 6) AS atr FROM sa""")
def seeded_atr(spark, sf):
    """Wilder's ATR seeded by the mean of its first fourteen ranges."""
    return rounded(dk.seeded_atr(calm(spark, sf)).select("symbol", "open_time_ms", "atr"), 6, "atr")


@query("SELECT p_brand AS symbol, max(length(coalesce(split_part(CAST(p_retailprice AS VARCHAR), '.', 2), '')))::INT AS digits, power(10.0, -max(length(coalesce(split_part(CAST(p_retailprice AS VARCHAR), '.', 2), '')))) AS tick FROM part GROUP BY p_brand")
def tick_sizes(spark, sf):
    """Ticks by brand from the decimals of the prices' texts."""
    return dk.tick_sizes(src.read(spark, sf, "part").select(F.col("p_brand").alias("symbol"), F.col("p_retailprice").cast("string").alias("price")), "price")


@query(f"""WITH {BARS_1D}, g AS (SELECT *, sum(gap) OVER (PARTITION BY symbol ORDER BY open_time_ms) AS seg FROM (SELECT *, CASE WHEN open_time_ms - {lag('open_time_ms', 1)} <> {DAY} THEN 1 ELSE 0 END AS gap FROM bars)) SELECT symbol, count(*) AS n FROM g WHERE seg = 0 GROUP BY symbol""")
def gap_checked(spark, sf):
    """Each symbol's candles before its first gap, under a check that would raise at a gap."""
    first = src.segments(src.bars_1d(spark, sf), DAY).where("segment = 0").drop("segment")
    return dk.gap_free(first, DAY).groupBy("symbol").agg(F.count("*").alias("n"))


_L = "CASE WHEN p_up >= 0.55 AND median_net > 0 THEN 'UP' WHEN p_up <= 0.45 AND -median_gross - greatest(median_gross - median_net, 0) > 0 THEN 'DOWN' ELSE 'MIXED' END"


@query(f"""WITH {FORECAST}, it AS (SELECT id, families, regime, NOT list_has_any(families, ['B2', 'B4']) AND (list_contains(families, 'F2') OR id % 4 <> 0) AS allow_short FROM items), sd AS (SELECT *, d AS want FROM it, (VALUES ('UP'), ('DOWN')) v(d) WHERE d = 'UP' OR allow_short),
hz2 AS (SELECT *, CASE WHEN want = 'DOWN' AND (regime = 'BULL' OR list_contains(families, 'F2')) THEN 30 ELSE 60 END AS h FROM sd), fc AS (SELECT *, {_L} AS label FROM forecast WHERE n IS NOT NULL),
j AS (SELECT hz2.id, want, len(families) AS nf, fc.n, p_up, median_gross, median_net, label, CASE WHEN want = 'UP' THEN p_up >= 0.5 AND median_net >= 0 ELSE p_up <= 0.5 AND -median_gross - greatest(median_gross - median_net, 0) >= 0 END AS mild FROM hz2 JOIN fc ON fc.id = hz2.id AND fc.horizon = h),
g AS (SELECT id, want, nf, count(*) AS seen, bool_and(label = want OR (label = 'MIXED' AND mild)) AS permit, bool_or(label = want) AS asserts, sum(n * p_up) / sum(n) AS p_up, sum(n * median_gross) / sum(n) AS median_gross, sum(n * median_net) / sum(n) AS median_net FROM j GROUP BY ALL), w AS (SELECT id, want FROM g WHERE seen = nf AND permit AND asserts AND {_L} = want)
SELECT it.id, CASE WHEN count(want) = 1 THEN max(want) ELSE 'MIXED' END AS direction FROM it LEFT JOIN w USING (id) GROUP BY it.id""")
def strategy_directions(spark, sf):
    """The direction that one playbook supports at its own horizon, for each newest signal."""
    l = signals(spark, sf)
    short = ~F.arrays_overlap("families", F.array(F.lit("B2"), F.lit("B4"))) & (F.array_contains("families", "F2") | (F.col("id") % 4 != 0))
    return dk.strategy_direction(newest(l).select("id", "families", "regime", short.alias("allow_short")), forecast_frame(l), strategy, lg.HORIZON_OF)


@query(f"""WITH {CALM}, r AS (SELECT symbol, open_time_ms, close, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) - 1 AS i FROM bars), x AS (SELECT a.symbol, h, a.i, b.close > a.close AS up FROM r a CROSS JOIN (VALUES (3), (6), (12)) v(h) JOIN r b ON b.symbol = a.symbol AND b.i = a.i + h WHERE a.i % h = 0) SELECT symbol, h::INT AS horizon, count(*) AS n, round(avg(up::INT), 9) AS base_rate FROM x GROUP BY ALL""")
def horizon_base_rates(spark, sf):
    """Base rates of several horizons by symbol over disjoint outcome windows."""
    w = mk.series()
    r = calm(spark, sf).withColumns({"i": F.row_number().over(w) - 1, **{f"c{h}": F.lead("close", h).over(w) for h in (3, 6, 12)}})
    long = r.select("symbol", "i", "close", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"c{h}").alias("later")) for h in (3, 6, 12)])).alias("x")).select("symbol", "i", "close", "x.*")
    return rounded(long.where("later is not null and i % horizon = 0").groupBy("symbol", "horizon").agg(F.count("*").alias("n"), F.avg((F.col("later") > F.col("close")).cast("double")).alias("base_rate")), 9, "base_rate")


@query(f"""WITH {LEDGER}, w AS (SELECT id, symbol, score, status IS NOT NULL AS confirmed FROM ledger WHERE {NOW} - bar_ms BETWEEN 0 AND {3 * DAY}) SELECT id, confirmed, row_number() OVER (ORDER BY confirmed DESC, score DESC, symbol, id)::INT AS place FROM w ORDER BY place LIMIT 5""")
def watch_list(spark, sf):
    """The first five fresh records: confirmed ones first, then by score; older ones have expired."""
    r = signals(spark, sf).where((F.lit(NOW) - F.col("bar_ms")).between(0, 3 * DAY)).select("id", "symbol", "score", F.col("status").isNotNull().alias("confirmed"))
    top = r.orderBy(F.desc("confirmed"), F.desc("score"), "symbol", "id").limit(5)
    return top.select("id", "confirmed", F.row_number().over(Window.orderBy(F.desc("confirmed"), F.desc("score"), "symbol", "id")).alias("place"))


@query(f"""WITH {LEDGER}, g AS (SELECT strategy, count(*) AS n, avg(net) AS m, max(bar_ms) AS trained_ms FROM ledger GROUP BY strategy) SELECT strategy, to_json({{'strategy': strategy, 'n': n, 'verified': m > 2}}) AS model, m > 2 AS verified FROM g""")
def model_snapshot(spark, sf):
    """One JSON row for each model, and whether it is verified."""
    g = signals(spark, sf).groupBy("strategy").agg(F.count("*").alias("n"), F.avg("net").alias("m"))
    return g.select("strategy", F.to_json(F.struct("strategy", "n", (F.col("m") > 2).alias("verified"))).alias("model"), (F.col("m") > 2).alias("verified"))


@query(f"""WITH RECURSIVE {LEDGER}, o AS (SELECT family AS arm, id, symbol, bar_ms AS t, bar_ms // {DAY} AS day, row_number() OVER (PARTITION BY family ORDER BY bar_ms, score DESC, symbol, id) AS k FROM ledger),
f AS (SELECT DISTINCT arm, 0::BIGINT AS k, CAST(NULL AS BIGINT) AS id, []::STRUCT(s VARCHAR, t BIGINT)[] AS places, CAST(NULL AS BIGINT) AS day, 0 AS n, FALSE AS ok FROM o
  UNION ALL SELECT arm, k, id, CASE WHEN ok THEN list_append(kept, {{'s': symbol, 't': t + {2 * DAY}}}) ELSE kept END, day, had + CAST(ok AS INT), ok FROM (
  SELECT arm, k, id, symbol, t, day, kept, had, had < 2 AND len(list_filter(kept, lambda p: p.s = symbol)) = 0 AS ok FROM (SELECT o.*, list_filter(f.places, lambda p: p.t > o.t) AS kept, CASE WHEN o.day = f.day THEN f.n ELSE 0 END AS had FROM f JOIN o ON o.arm = f.arm AND o.k = f.k + 1)))
SELECT arm, id FROM f WHERE ok""")
def daily_capped_signals(spark, sf):
    """At most two signals of a family and day, best first, one open for each symbol."""
    r = signals(spark, sf).select(F.col("family").alias("arm"), "id", "symbol", F.col("bar_ms").alias("t"), (F.col("bar_ms") + F.lit(2 * DAY).cast("long")).alias("until"), "score")
    return sm.daily_capped(r, 2).select("arm", "id")


_WIDE = [(n, f"rn >= {n} AND max(high) OVER r{n} > min(low) OVER r{n} AND max(high) OVER r{n} - min(low) OVER r{n} <= 3 * atr") for n in range(20, 61)]
_STEP = """SELECT symbol, rn, t, signal, CASE WHEN over THEN NULL ELSE lo END AS lo, CASE WHEN over THEN NULL ELSE hi END AS hi, CASE WHEN over THEN NULL ELSE poc END AS poc, side, far, swept, age, inside, close AS before, poc AS mid, far AS stop, swept AS since FROM (
  SELECT *, side <> 0 AND (NOT was AND inside AND age > 12 OR was AND (age > 12 OR crossed)) AS over, CASE WHEN was AND age <= 12 AND crossed THEN side END AS signal FROM (
  SELECT *, was OR side <> 0 AND CASE WHEN side > 0 THEN close > lo ELSE close < hi END AS inside, side * (close - poc) > 0 AND side * (before - poc) <= 0 AS crossed FROM (
  SELECT symbol, rn, t, close, lo, hi, poc, side, was, before, swept, age, CASE WHEN side = 0 OR was THEN far WHEN side > 0 THEN least(far, low) ELSE greatest(far, high) END AS far FROM (
  SELECT *, CASE WHEN old <> 0 OR side = 0 THEN far0 WHEN side > 0 THEN low ELSE high END AS far, CASE WHEN old <> 0 THEN swept0 ELSE t END AS swept, CASE WHEN old <> 0 THEN age0 + 1 ELSE 0 END AS age FROM (
  SELECT *, CASE WHEN old <> 0 THEN old WHEN (low < lo) = (high > hi) THEN 0 WHEN low < lo THEN 1 ELSE -1 END AS side FROM (
  SELECT b.symbol, b.rn, b.open_time_ms AS t, b.high, b.low, b.close, s.lo, s.hi, s.poc, s.side AS old, s.inside AND s.side <> 0 AS was, s.before, s.far AS far0, s.swept AS swept0, s.age AS age0 FROM st s JOIN b ON b.symbol = s.symbol AND b.rn = s.rn + 1 WHERE s.lo IS NOT NULL))))))"""


@query(f"""WITH RECURSIVE {IND}, f AS (SELECT *, (CASE {' '.join(f'WHEN {c} THEN {n}' for n, c in _WIDE)} END)::INT AS n FROM ind WINDOW {', '.join(f'r{n} AS ({P} {n - 1} PRECEDING AND CURRENT ROW)' for n, _ in _WIDE)}),
e AS (SELECT a.symbol, a.rn, a.n, min(b.low) AS lo, max(b.high) AS hi, list({{'l': b.low, 'h': b.high, 'v': b.volume}} ORDER BY b.rn) AS hist FROM f a JOIN f b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - a.n + 1 AND a.rn WHERE a.n IS NOT NULL GROUP BY ALL),
v AS (SELECT symbol, rn, lo, hi, row, (hi - lo) / 40 AS w, list_sum(list_transform(hist, lambda x: x.v * CASE WHEN x.h > x.l THEN greatest(least(x.h, lo + row * ((hi - lo) / 40) + (hi - lo) / 40) - greatest(x.l, lo + row * ((hi - lo) / 40)), 0) / (x.h - x.l) ELSE CAST(x.l >= lo + row * ((hi - lo) / 40) AND x.l < lo + row * ((hi - lo) / 40) + (hi - lo) / 40 AS INT) END)) AS vol FROM (SELECT *, unnest(range(40)) AS row FROM e)),
p AS (SELECT symbol, rn, lo, hi, lo + (row + 0.5) * w AS poc FROM v QUALIFY row_number() OVER (PARTITION BY symbol, rn ORDER BY vol DESC, row) = 1),
b AS MATERIALIZED (SELECT ind.symbol, ind.rn, open_time_ms, high, low, close, lo, hi, poc FROM ind LEFT JOIN p USING (symbol, rn)),
st AS (SELECT symbol, 0::BIGINT AS rn, 0::BIGINT AS t, 0 AS signal, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, CAST(NULL AS DOUBLE) AS poc, 0 AS side, 0.0::DOUBLE AS far, 0::BIGINT AS swept, 0 AS age, FALSE AS inside, 0.0::DOUBLE AS before, 0.0::DOUBLE AS mid, 0.0::DOUBLE AS stop, 0::BIGINT AS since FROM (SELECT DISTINCT symbol FROM b)
  UNION ALL (SELECT b.symbol, b.rn, b.open_time_ms, 0, b.lo, b.hi, b.poc, 0, 0, 0, 0, FALSE, b.close, 0, 0, 0 FROM st s JOIN b ON b.symbol = s.symbol AND b.rn = s.rn + 1 WHERE s.lo IS NULL
  UNION ALL {_STEP}))
SELECT symbol, t AS open_time_ms, CASE WHEN signal > 0 THEN 'LONG' ELSE 'SHORT' END AS side, round(mid, 6) AS poc, round(stop, 6) AS stop, since AS sweep_ms FROM st WHERE signal <> 0""")
def sweep_signals(spark, sf):
    """Range, sweep, return and close across the point of control, in that order, on daily candles."""
    return rounded(sw.sweep_signals(calm(spark, sf), k=3.0), 6, "poc", "stop")
