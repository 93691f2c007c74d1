"""Registered outcome queries with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.scalars import frame, guarded, series, true_range
from candela.operators import events as ev
from candela.operators import outcomes as oc
from candela.plans.catalog import DAY, query, rounded
from candela.plans.market import CALM, P, _full, calm, lag

H, NOW, GRACE = 12, 990_000_000_000, 7 * DAY
LEVELS = (0.5, 1, 2)
#: Candles with every 37th day missing, seen up to NOW; events are closes above the 12 highs before.
EV = CALM + f""",
tb AS (SELECT * FROM bars WHERE (open_time_ms // {DAY}) % 37 <> 5 AND open_time_ms + {DAY} <= {NOW}),
e0 AS (SELECT *, {_full('max({x})', 'high', 12, 1)} AS hi12, greatest(high - low, abs(high - {lag('close', 1)}), abs(low - {lag('close', 1)})) AS tr FROM bars),
e1 AS (SELECT *, {_full('avg({x})', 'tr', 13)} AS atr FROM e0),
ev AS (SELECT symbol, open_time_ms AS event_ms, close AS source, CASE WHEN (open_time_ms // {DAY}) % 2 = 0 THEN 1 ELSE -1 END AS side, atr / close * 10000 AS atr_bps, event_ms + {H} * {DAY} + {DAY - 1} AS deadline FROM e1 WHERE close > hi12 - 20 AND open_time_ms + {DAY} <= {NOW}),
pa AS (SELECT e.*, ((b.open_time_ms - e.event_ms) // {DAY})::INT AS k, open, high, low, close FROM ev e JOIN tb b ON b.symbol = e.symbol AND b.open_time_ms > e.event_ms AND b.open_time_ms <= e.event_ms + {H * DAY})"""


def thin(spark, sf):
    return calm(spark, sf).where((F.floor(F.col("open_time_ms") / DAY) % 37 != 5) & (F.col("open_time_ms") + DAY <= NOW))


def base_events(spark, sf):
    w = series()
    r = calm(spark, sf).withColumns({"hi12": guarded(F.max, F.col("high"), frame(w, 12, -1), 12), "tr": true_range(w)})
    r = r.withColumn("atr", guarded(F.avg, F.col("tr"), frame(w, 14), 14)).where((F.col("close") > F.col("hi12") - 20) & (F.col("open_time_ms") + DAY <= NOW))
    return r.select("symbol", F.col("open_time_ms").alias("event_ms"), F.col("close").alias("source"), F.when(F.floor(F.col("open_time_ms") / DAY) % 2 == 0, 1).otherwise(-1).alias("side"), (F.col("atr") / F.col("close") * 10_000).alias("atr_bps"))


def with_paths(spark, sf):
    return oc.with_path(base_events(spark, sf), thin(spark, sf), DAY, H)


def deadline():
    return F.col("event_ms") + H * DAY + (DAY - 1)



@query(f"""WITH {EV}, m AS (SELECT *, high >= source * exp(0.015) AS u, low <= source * exp(-0.015) AS d FROM pa),
g AS (SELECT symbol, event_ms, min(k) FILTER (u OR d) AS hk, max(k) AS lk, arg_max(close, k) AS lc FROM m GROUP BY ALL),
r AS (SELECT ev.*, hk, lk, lc, u, d, m.close AS hc, ev.deadline <= {NOW} AND lk IS NOT NULL AS timed FROM ev LEFT JOIN g USING (symbol, event_ms) LEFT JOIN m ON m.symbol = ev.symbol AND m.event_ms = ev.event_ms AND m.k = g.hk),
s AS (SELECT *, CASE WHEN u AND d THEN 'UNCLEAR' WHEN hk IS NOT NULL THEN CASE WHEN u = (side > 0) THEN 'TARGET' ELSE 'STOP' END WHEN timed THEN 'TIME' WHEN {NOW} - deadline > {GRACE} THEN 'DROPPED' ELSE 'OPEN' END AS resolution,
  CASE WHEN u AND d THEN -150.0 WHEN hk IS NOT NULL THEN CASE WHEN u = (side > 0) THEN 150.0 ELSE -150.0 END WHEN timed THEN ln(lc / source) * 10000 * side END AS gross FROM r)
SELECT symbol, event_ms, side, resolution, (CASE WHEN hk IS NOT NULL THEN hk WHEN timed THEN lk END)::INT AS held, round(CASE WHEN u AND d THEN hc WHEN u THEN source * exp(0.015) WHEN d THEN source * exp(-0.015) WHEN timed THEN lc END, 6) AS exit, round(gross, 6) AS gross_bps, round(gross - 12, 6) AS net_bps FROM s""")
def barrier_settlement(spark, sf):
    """Signals settled at log-symmetric barriers: target, stop, both, time, open and dropped."""
    return rounded(oc.barrier_settlement(with_paths(spark, sf), deadline(), NOW, 150, 12, GRACE), 6, "exit", "gross_bps", "net_bps")


FIRST = EV + f""",
pr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, event_ms ORDER BY k) AS r FROM pa) WHERE k = r),
en AS (SELECT symbol, event_ms, open AS entry FROM pr WHERE k = 1),
mk AS (SELECT pr.*, entry, CASE WHEN side > 0 THEN high >= entry * (1 + 180 / 10000.0) ELSE low <= entry * (1 - 180 / 10000.0) END AS t, CASE WHEN side > 0 THEN low <= entry * (1 - least(greatest(atr_bps, 120), 200) / 10000) ELSE high >= entry * (1 + least(greatest(atr_bps, 120), 200) / 10000) END AS s FROM pr JOIN en USING (symbol, event_ms)),
fg AS (SELECT symbol, event_ms, min(k) FILTER (t OR s) AS hk, max(k) AS lk, arg_max(close, k) AS lc FROM mk GROUP BY ALL),
fr AS (SELECT ev.*, en.entry, hk, lc, mk.t, mk.s, lk = {H} AND ev.deadline <= {NOW} AS whole FROM ev LEFT JOIN en USING (symbol, event_ms) LEFT JOIN fg USING (symbol, event_ms) LEFT JOIN mk ON mk.symbol = ev.symbol AND mk.event_ms = ev.event_ms AND mk.k = fg.hk),
fx AS (SELECT *, CASE WHEN s THEN 'STOP' WHEN t THEN 'TARGET' WHEN whole THEN 'TIME_EXIT' WHEN {NOW} - deadline > {GRACE} THEN 'DATA_MISSING' ELSE 'PENDING' END AS resolution, CASE WHEN hk IS NOT NULL THEN hk WHEN whole THEN {H} END AS held,
  CASE WHEN s THEN entry * (1 - side * least(greatest(atr_bps, 120), 200) / 10000) WHEN t THEN entry * (1 + side * 180 / 10000.0) WHEN whole THEN lc END AS exit FROM fr),
fe AS (SELECT fx.symbol, fx.event_ms, max(high) AS hi, min(low) AS lo FROM fx JOIN pr ON pr.symbol = fx.symbol AND pr.event_ms = fx.event_ms AND pr.k <= fx.held GROUP BY ALL)"""


@query(f"""WITH {FIRST} SELECT symbol, event_ms, side, round(entry, 6) AS entry, resolution, coalesce(s AND t, FALSE) AS ambiguous, held::INT AS held, round(ln(exit / entry) * 10000 * side, 6) AS gross_bps, round(ln(exit / entry) * 10000 * side - 12, 6) AS net_bps,
  round(CASE WHEN hi IS NOT NULL THEN greatest(CASE WHEN side > 0 THEN ln(hi / entry) ELSE ln(entry / lo) END * 10000, 0) ELSE 0 END, 6) AS mfe_bps, round(CASE WHEN hi IS NOT NULL THEN greatest(CASE WHEN side > 0 THEN ln(entry / lo) ELSE ln(hi / entry) END * 10000, 0) ELSE 0 END, 6) AS mae_bps FROM fx LEFT JOIN fe USING (symbol, event_ms)""")
def first_touch(spark, sf):
    """Both-sided brackets with volatility stops over the gap-free prefix: ties, time exits, pending and missing data, MFE and MAE."""
    stop = F.least(F.greatest("atr_bps", F.lit(120.0)), F.lit(200.0))
    r = oc.first_touch(with_paths(spark, sf), H, F.lit(180.0), stop, 12, deadline() <= NOW, F.lit(NOW) - deadline() > GRACE)
    return rounded(r, 6, "entry", "gross_bps", "net_bps", "mfe_bps", "mae_bps")


@query(f"""WITH {EV}, l AS (SELECT ev.*, level FROM ev, (VALUES (0.5), (1.0), (2.0)) v(level)), h AS (SELECT l.symbol, l.event_ms, l.level, count(k) AS n, min(k) FILTER (CASE WHEN l.side > 0 THEN high >= l.source * (1 + l.level / 100) ELSE low <= l.source * (1 - l.level / 100) END) AS hk FROM l LEFT JOIN pa ON pa.symbol = l.symbol AND pa.event_ms = l.event_ms GROUP BY ALL)
SELECT l.symbol, l.event_ms, side, CAST(l.level AS DOUBLE) AS level, CASE WHEN hk IS NOT NULL THEN TRUE WHEN n = {H} OR {NOW} - deadline > {GRACE} THEN FALSE END AS touched, hk::INT AS touch_k FROM l JOIN h USING (symbol, event_ms, level)""")
def level_touches(spark, sf):
    """Touch of each level from the source price, unknown while the window is incomplete."""
    return oc.level_touches(with_paths(spark, sf), H, LEVELS, F.lit(NOW) - deadline() > GRACE)


PAPER = EV + f""",
pe AS (SELECT symbol, event_ms, open AS entry FROM pa WHERE k = 1), ps AS (SELECT pa.*, entry, 1.5 AS stop_pct FROM pa JOIN pe USING (symbol, event_ms)),
pg AS (SELECT symbol, event_ms, any_value(entry) AS entry, any_value(stop_pct) AS stop_pct, count(*) AS n, any_value(least({H}, ({NOW} - event_ms) // {DAY} - 1)) AS seen, any_value(event_ms + {H + 1} * {DAY} <= {NOW}) AS mature, min(k) FILTER ((1 - low / entry) * 100 >= stop_pct - 1e-9) AS sk, arg_max(close, k) AS lc, max((high / entry - 1) * 100) AS mfe, max((1 - low / entry) * 100) AS mae FROM ps GROUP BY ALL),
pl AS (SELECT pg.*, level, n = seen AS complete, (SELECT min(k) FROM ps WHERE ps.symbol = pg.symbol AND ps.event_ms = pg.event_ms AND (high / ps.entry - 1) * 100 >= level - 1e-9) AS hk FROM pg, (VALUES (0.5), (1.0), (2.0)) v(level)),
pq AS (SELECT *, coalesce(hk = sk, FALSE) AS ambiguous, CASE WHEN NOT complete OR coalesce(hk = sk, FALSE) THEN NULL WHEN hk IS NOT NULL THEN sk IS NULL OR hk < sk WHEN mature OR sk IS NOT NULL THEN FALSE END AS first_before_stop FROM pl),
paper AS (SELECT symbol, event_ms, CAST(level AS DOUBLE) AS level, mature, complete, CASE WHEN complete THEN CASE WHEN hk IS NOT NULL THEN TRUE WHEN mature THEN FALSE END END AS hit, first_before_stop, ambiguous,
  CASE WHEN complete AND NOT ambiguous THEN CASE WHEN first_before_stop THEN level * 100 - 20 WHEN sk IS NOT NULL THEN -stop_pct * 100 - 20 WHEN mature THEN (lc / entry - 1) * 10000 - 20 END END AS net_bps, greatest(0, mfe) AS mfe_pct, greatest(0, mae) AS mae_pct FROM pq)"""


def papers(spark, sf):
    seen = F.least(F.lit(H), F.floor((F.lit(NOW) - F.col("event_ms")) / DAY) - 1)
    return oc.paper_outcome(with_paths(spark, sf), H, LEVELS, F.lit(1.5), 20, F.col("event_ms") + (H + 1) * DAY <= NOW, seen)


@query(f"WITH {PAPER} SELECT * REPLACE (round(net_bps, 6) AS net_bps, round(mfe_pct, 6) AS mfe_pct, round(mae_pct, 6) AS mae_pct) FROM paper")
def paper_outcomes(spark, sf):
    """Levels against a stop over complete windows: hit, first before the stop (unknown in one candle), net, MFE and MAE."""
    return rounded(papers(spark, sf), 6, "net_bps", "mfe_pct", "mae_pct")


@query(f"""WITH {PAPER}, g AS (SELECT symbol, level, count(*) AS records, count(*) FILTER (NOT mature) AS pending, count(*) FILTER (mature AND NOT complete) AS missing, count(*) FILTER (mature AND complete) AS n, count(*) FILTER (mature AND complete AND hit) AS hits,
  count(*) FILTER (mature AND complete AND first_before_stop IS NOT NULL) AS first_n, count(*) FILTER (mature AND complete AND first_before_stop) AS first_wins, count(*) FILTER (mature AND complete AND first_before_stop IS NULL) AS ambiguous, avg(net_bps) FILTER (mature AND complete) AS m FROM paper GROUP BY ALL)
SELECT * EXCLUDE (m), round(m, 6) AS mean_net, round(hits / nullif(n, 0), 9) AS rate, round(CASE WHEN n > 0 THEN greatest(0, (hits / n + 1.959963984540054 ** 2 / (2 * n) - 1.959963984540054 * sqrt(hits / n * (1 - hits / n) / n + 1.959963984540054 ** 2 / (4 * n * n))) / (1 + 1.959963984540054 ** 2 / n)) END, 9) AS low FROM g""")
def level_metrics(spark, sf):
    """Touch metrics by symbol and level with the Wilson bound, first-before-stop wins and ties."""
    from candela.functions.scalars import wilson

    r = oc.level_metrics(papers(spark, sf), "symbol", "level")
    return rounded(rounded(r.withColumns({"rate": F.col("hits") / F.nullif("n", F.lit(0)), "low": wilson(F.col("hits"), F.col("n"))[0]}), 6, "mean_net"), 9, "rate", "low")


def _bracket_sql(side: int) -> str:
    t, s = (("high >= entry * 1.02", "low <= entry * 0.985") if side > 0 else ("low <= entry * 0.98", "high >= entry * 1.015"))
    return f"""en2 AS (SELECT symbol, event_ms, open AS entry FROM pa WHERE k = 1), b1 AS (SELECT pa.*, entry, CASE WHEN {s} THEN 'STOP' WHEN {t} THEN 'TARGET' END AS r FROM pa JOIN en2 USING (symbol, event_ms)),
b2 AS (SELECT symbol, event_ms, entry, count(*) AS n, min(k) FILTER (r IS NOT NULL) AS hk, arg_min(r, k) FILTER (r IS NOT NULL) AS hr, max(close) FILTER (k = {H}) AS lc FROM b1 GROUP BY ALL), b3 AS (SELECT b2.*, CASE WHEN hk IS NULL THEN n = {H} ELSE (SELECT count(*) FROM pa WHERE pa.symbol = b2.symbol AND pa.event_ms = b2.event_ms AND pa.k <= hk) = hk END AS ok FROM b2),
b4 AS (SELECT *, CASE WHEN ok THEN CASE hr WHEN 'STOP' THEN entry * {0.985 if side > 0 else 1.015} WHEN 'TARGET' THEN entry * {1.02 if side > 0 else 0.98} ELSE lc END END AS exit FROM b3)
SELECT symbol, event_ms, round(entry, 6) AS entry, CASE WHEN NOT ok THEN 'DATA_MISSING' ELSE coalesce(hr, 'TIME_EXIT') END AS reason, CASE WHEN ok THEN coalesce(hk, {H}) END::BIGINT AS held, round((exit / entry - 1) * 10000 * {side}, 6) AS gross_bps FROM b4"""


@query(f"WITH {EV}, {_bracket_sql(-1)}")
def short_brackets(spark, sf):
    """Short brackets without gap fills, stop first."""
    events = base_events(spark, sf).select("symbol", F.col("event_ms").alias("open_time_ms"))
    r = ev.bracket_outcomes(events, thin(spark, sf), DAY, H, 200, 150, side=-1, gaps=False)
    return rounded(r.select("symbol", "event_ms", "entry", "reason", "held", "gross_bps"), 6, "entry", "gross_bps")


@query(f"""WITH {EV}, n AS (SELECT symbol, event_ms FROM pa GROUP BY ALL HAVING count(*) = {H}), w AS (SELECT pa.*, first(open) OVER (PARTITION BY symbol, event_ms ORDER BY k) AS entry FROM pa JOIN n USING (symbol, event_ms)),
s AS (SELECT symbol, event_ms, any_value(entry) AS entry, any_value(entry * (1 - atr_bps / 10000)) AS stop, min(k) FILTER (low <= entry * (1 - atr_bps / 10000)) AS hk, max(close) FILTER (k = {H}) AS lc FROM w GROUP BY ALL)
SELECT s.symbol, s.event_ms, round(s.entry, 6) AS entry, CASE WHEN hk IS NULL THEN 'TIME' ELSE 'STOP' END AS reason, round((CASE WHEN any_value(hk) IS NULL THEN any_value(lc) ELSE max(CASE WHEN open <= stop AND k > 1 THEN open ELSE stop END) FILTER (k = hk) END / s.entry - 1) * 10000, 6) AS gross_bps,
  coalesce(bool_or(high >= s.entry * 1.01) FILTER (hk IS NULL OR k < hk), FALSE) AS touched_1, coalesce(bool_or(high >= s.entry * 1.02) FILTER (hk IS NULL OR k < hk), FALSE) AS touched_2 FROM s JOIN w USING (symbol, event_ms) GROUP BY s.symbol, s.event_ms, s.entry, hk""")
def atr_stop_hold(spark, sf):
    """Hold with a stop of one ATR and no target; levels touched before the stop's candle."""
    return rounded(oc.stop_hold(with_paths(spark, sf), H, F.col("atr_bps"), (1, 2)), 6, "entry", "gross_bps")


@query(f"""WITH {EV}, n AS (SELECT symbol, event_ms FROM pa GROUP BY ALL HAVING count(*) = {H}), w AS (SELECT pa.* EXCLUDE (side), first(open) OVER (PARTITION BY symbol, event_ms ORDER BY k) AS entry, last(close) OVER (PARTITION BY symbol, event_ms ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lc FROM pa JOIN n USING (symbol, event_ms)),
x AS (SELECT w.*, side, level FROM w, (VALUES (1), (-1)) a(side), (VALUES (0.5), (1.0), (2.0)) b(level)),
g AS (SELECT symbol, event_ms, side, level, any_value(entry) AS entry, any_value(lc) AS lc, min(k) FILTER (CASE WHEN side > 0 THEN high >= entry * (1 + level / 100) ELSE low <= entry * (1 - level / 100) END) AS hk, min(k) FILTER (CASE WHEN side > 0 THEN low <= entry * 0.99 ELSE high >= entry * 1.01 END) AS sk FROM x GROUP BY ALL)
SELECT symbol, event_ms, side, CAST(level AS DOUBLE) AS level, hk IS NOT NULL AS touched, coalesce(hk < coalesce(sk, {H + 1}), FALSE) AS before_stop, round(ln(lc / entry) * 10000 * side - 12, 6) AS close_net_bps FROM g""")
def two_sided_labels(spark, sf):
    return rounded(oc.two_sided(with_paths(spark, sf), H, LEVELS, 1.0, 12), 6, "close_net_bps")


@query(f"""WITH {EV}, e AS (SELECT symbol, max(open_time_ms) + {DAY - 1} AS data_end FROM tb GROUP BY symbol), o AS (SELECT ev.symbol, ev.event_ms, ev.deadline FROM ev LEFT JOIN pa ON pa.symbol = ev.symbol AND pa.event_ms = ev.event_ms GROUP BY ALL HAVING count(k) < {H})
SELECT symbol, event_ms, CASE WHEN data_end < deadline THEN 'PENDING' ELSE 'UNKNOWN_DATA' END AS status, deadline AS reserved_until FROM o JOIN e USING (symbol)""")
def open_status(spark, sf):
    """What the unresolved events wait for: data still to come, or data that never came."""
    ends = thin(spark, sf).groupBy("symbol").agg((F.max("open_time_ms") + (DAY - 1)).alias("data_end"))
    return oc.open_status(with_paths(spark, sf).where(F.size("path") < H).join(ends, "symbol"), deadline(), F.col("data_end"))


@query(f"""WITH {EV}, b AS (SELECT symbol, open_time_ms AS event_ms, close AS source FROM tb WHERE (open_time_ms % {7 * DAY}) // {DAY} IN (0, 3)), j AS (SELECT b.symbol, b.event_ms, source, count(*) AS n, max(high) AS hi, min(low) AS lo FROM b JOIN tb t ON t.symbol = b.symbol AND t.open_time_ms > b.event_ms AND t.open_time_ms <= b.event_ms + {H * DAY} GROUP BY ALL HAVING count(*) = {H})
SELECT symbol, count(*) AS n, count(*) FILTER (hi >= source * 1.01) AS up, count(*) FILTER (lo <= source * 0.99) AS down FROM j GROUP BY symbol""")
def clock_baseline(spark, sf):
    """An unconditional baseline: touches after every symbol's candles at two fixed places of the week."""
    r = oc.with_path(oc.clock_events(thin(spark, sf), 7 * DAY, (0, 3), DAY), thin(spark, sf), DAY, H).where(F.size("path") == H)
    s = F.col("source")
    return r.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.exists("path", lambda x: x.high >= s * 1.01)).alias("up"), F.count_if(F.exists("path", lambda x: x.low <= s * 0.99)).alias("down"))


@query(f"WITH {EV} SELECT symbol, event_ms, source, side, round(atr_bps, 6) AS atr_bps, event_ms // {7 * DAY} AS period FROM ev QUALIFY row_number() OVER (PARTITION BY symbol, event_ms // {7 * DAY} ORDER BY event_ms) = 1")
def first_of_week(spark, sf):
    """The first event of each symbol and week."""
    return rounded(oc.first_of_period(base_events(spark, sf), 7 * DAY), 6, "atr_bps")


@query(f"""WITH {EV}, x AS (SELECT symbol, open_time_ms, lead(open_time_ms, 1) OVER w AS t1, lead(open, 1) OVER w AS o1, {', '.join(f'lead(open_time_ms, {k}) OVER w AS t{k}_, lead(close, {k}) OVER w AS c{k}' for k in (3, 6, 12))} FROM tb WINDOW w AS (PARTITION BY symbol ORDER BY open_time_ms)),
y AS (SELECT ev.symbol, ev.event_ms, side, CASE WHEN t1 = event_ms + {DAY} THEN o1 END AS entry, {', '.join(f'CASE WHEN t{k}_ = event_ms + {k} * {DAY} THEN c{k} END AS c{k}' for k in (3, 6, 12))} FROM ev JOIN x ON x.symbol = ev.symbol AND x.open_time_ms = ev.event_ms)
SELECT symbol, event_ms, side, {', '.join(f"round(ln(c{k} / entry) * 10000 * side - 12, 6) AS net_{k}, CASE WHEN ln(c{k} / entry) IS NOT NULL THEN 'SETTLED' WHEN {NOW} - (event_ms + {k} * {DAY}) > {GRACE} THEN 'DATA_MISSING' ELSE 'PENDING' END AS status_{k}" for k in (3, 6, 12))} FROM y""")
def setup_forward_test(spark, sf):
    """A frozen direction's net at three holds, pending before and missing after the grace time."""
    bars = thin(spark, sf)
    e = base_events(spark, sf)
    r = ev.time_exits(e.select("symbol", F.col("event_ms").alias("open_time_ms")), bars, DAY).withColumnRenamed("open_time_ms", "event_ms").join(e.select("symbol", "event_ms", "side"), ["symbol", "event_ms"])
    out = []
    for k in (3, 6, 12):
        net = F.col(f"ret_{k}") * F.col("side") - 12
        out += [F.round(net, 6).alias(f"net_{k}"), F.when(net.isNotNull(), "SETTLED").when(F.lit(NOW) - (F.col("event_ms") + k * DAY) > GRACE, "DATA_MISSING").otherwise("PENDING").alias(f"status_{k}")]
    return r.select("symbol", "event_ms", "side", *out)


GRIDS = (DAY, 5 * DAY)


@query(f"""WITH {EV}, rec AS (SELECT symbol || ':' || event_ms AS id, symbol, event_ms + {DAY} + ((event_ms // {DAY}) % 24) * 3600000 AS t, 0.5 + ((event_ms // {DAY}) % 3) * 0.5 AS stop FROM ev),
gr AS (SELECT *, (t // g + 1) * g AS s FROM rec, (VALUES ({GRIDS[0]}), ({GRIDS[1]})) v(g)),
cu AS MATERIALIZED (SELECT *, s + {H * DAY} <= {NOW} AS mature, (least(s + {H * DAY}, {NOW // DAY * DAY}) - s) // {DAY} AS due FROM gr),
pt AS MATERIALIZED (SELECT id, g, due, stop, (b.open_time_ms - s) // {DAY} + 1 AS k, open, high, low, close FROM cu JOIN tb b ON b.symbol = cu.symbol AND b.open_time_ms >= s AND b.open_time_ms < s + due * {DAY}),
en AS MATERIALIZED (SELECT id, g, max(open) FILTER (k = 1) AS entry, max(close) FILTER (k = due) AS last FROM pt GROUP BY id, g, due HAVING count(*) = due),
hi AS (SELECT id, g, level, min(k) FILTER ((high / entry - 1) * 100 >= level - 1e-9) AS hk, min(k) FILTER ((1 - low / entry) * 100 >= stop - 1e-9) AS sk FROM pt JOIN en USING (id, g), (VALUES {', '.join(f'({float(v)}::DOUBLE)' for v in LEVELS)}) l(level) GROUP BY ALL),
x AS (SELECT cu.id, g, s, mature, stop, entry IS NOT NULL AS complete, entry, last, l.level, hk, sk, coalesce(hk = sk, FALSE) AS twice, hk IS NOT NULL AND (sk IS NULL OR hk < sk) AS won FROM cu JOIN (VALUES {', '.join(f'({float(v)}::DOUBLE)' for v in LEVELS)}) l(level) ON TRUE LEFT JOIN en USING (id, g) LEFT JOIN hi USING (id, g, level))
SELECT id, g AS grid_ms, s AS entry_open_ms, mature, complete, entry AS entry_price, level, CASE WHEN hk IS NOT NULL THEN TRUE WHEN mature AND complete THEN FALSE END AS hit,
  CASE WHEN NOT twice AND (hk IS NOT NULL OR sk IS NOT NULL OR (mature AND complete)) THEN won END AS first_before_stop,
  round(CASE WHEN NOT twice THEN CASE WHEN won THEN level * 100 WHEN sk IS NOT NULL THEN -stop * 100 WHEN mature THEN (last / entry - 1) * 10000 END - 10 END, 6) AS net_bps FROM x""")
def grid_entries(spark, sf):
    """Signals entered on a fine and on a coarse grid of opens, against levels and a stop."""
    day = F.floor(F.col("event_ms") / DAY)
    r = base_events(spark, sf).select(F.concat_ws(":", "symbol", F.col("event_ms").cast("string")).alias("id"), "symbol", (F.col("event_ms") + DAY + (day % 24) * 3_600_000).alias("recorded_ms"), (0.5 + (day % 3) * 0.5).alias("stop_pct"), F.lit(10.0).alias("cost_bps"))
    return rounded(oc.grid_entries(r, thin(spark, sf), NOW, DAY, GRIDS, H, LEVELS), 6, "net_bps")
