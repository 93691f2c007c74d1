"""Registered ledger, gate and selection queries with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import ledgers as lg
from candela.plans.catalog import DAY, query, rounded
from candela.sources.ledger import signals

#: The ledger's newest quarter or so is open at this time.
NOW = 930_000_000_000
LEDGER = f"""
l0 AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderkey AS u FROM orders),
l1 AS (SELECT u AS id, 'C' || (o_custkey % 60) AS symbol, ['F1', 'F2', 'F3', 'B1', 'B2'][u % 5 + 1] AS family, CASE WHEN u % 3 = 0 THEN list_sort(list_distinct([['F1', 'F2', 'F3', 'B1', 'B2'][u % 5 + 1], ['F1', 'F2', 'F3', 'B1', 'B2'][u // 5 % 5 + 1]])) ELSE [['F1', 'F2', 'F3', 'B1', 'B2'][u % 5 + 1]] END AS families,
  ['BULL', 'TRANSITION', 'OFF'][u // 3 % 3 + 1] AS regime, CASE WHEN u % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, [15, 30, 60][u // 2 % 3 + 1]::INT AS horizon, (cents % 400) / 100.0 AS score, CAST(cents % 601 - 280 AS DOUBLE) AS gross, CAST(u % 5 + 10 AS DOUBLE) AS cost,
  epoch_ms(o_orderdate) + (u % 288) * 300000 + 299999 AS bar_ms, cents % 3 = 0 AS notified, CASE WHEN u % 17 <> 0 THEN (cents % 97) / 10.0 END AS spread_bps, CAST((cents % 1000) * 10000 AS DOUBLE) AS quote_volume, CAST(u % 41 - 20 AS DOUBLE) AS funding_bps, CAST(cents % 131 AS DOUBLE) AS volatility_bps,
  CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'p1' ELSE 'p2' END AS policy FROM l0),
ledger AS MATERIALIZED (SELECT *, CASE WHEN id % 11 <> 0 THEN gross - cost END AS net, CASE WHEN id % 13 <> 0 THEN CASE WHEN gross >= 150 THEN 'TARGET' WHEN gross <= -150 THEN 'STOP' ELSE 'TIME_EXIT' END END AS status, bar_ms + horizon * 60000 AS settled_ms,
  CASE WHEN direction = 'LONG' AND list_contains(families, 'F2') THEN 'FLUSH_RECOVERY_LONG' WHEN direction = 'LONG' AND regime = 'BULL' THEN 'BULL_CONTINUATION_LONG' WHEN direction = 'SHORT' AND regime = 'BULL' THEN 'BULL_EXHAUSTION_SHORT' WHEN direction = 'SHORT' AND list_contains(families, 'F2') THEN 'DOWNSIDE_CONTINUATION_SHORT' WHEN direction = 'LONG' THEN 'DIRECTIONAL_LONG' ELSE 'DIRECTIONAL_SHORT' END AS strategy FROM l1)"""
COHORT = ", ".join(lg.COHORT)
Z = 1.959963984540054


def _wilson(h: str, n: str, sign: str) -> str:
    p = f"({h} / {n})"
    edge = f"({p} + {Z * Z} / (2 * {n})) / (1 + {Z * Z} / {n}) {sign} {Z} * sqrt({p} * (1 - {p}) / {n} + {Z * Z} / (4.0 * {n} * {n})) / (1 + {Z * Z} / {n})"
    return f"greatest(0, {edge})" if sign == "-" else f"least(1, {edge})"


COHORTS = LEDGER + f""",
c0 AS (SELECT * EXCLUDE (family), unnest(families) AS family FROM ledger), c1 AS (SELECT *, 'all' AS audience FROM c0 UNION ALL SELECT *, CASE WHEN notified THEN 'notified' ELSE 'muted' END FROM c0),
c2 AS (SELECT *, bar_ms + horizon * 60000 <= {NOW} AS mature, status IS NOT NULL AS settled FROM c1),
c3 AS (SELECT {COHORT}, count(*) AS records, count(*) FILTER (mature) AS matured, count(*) FILTER (mature AND settled) AS resolved, count(*) FILTER (NOT mature) AS open, 0::BIGINT AS unknown_deadline, count(*) FILTER (NOT mature AND status = 'TARGET') AS early_hits, count(*) FILTER (mature AND status = 'TARGET') AS hits,
  count(DISTINCT CASE WHEN mature AND settled THEN bar_ms // {DAY} END) AS days, count(*) FILTER (mature AND status = 'STOP') AS stops, count(*) FILTER (mature AND status = 'TIME_EXIT') AS time_exits, count(*) FILTER (mature AND settled AND net IS NOT NULL) AS net_n, count(*) FILTER (mature AND settled AND net > 0) AS net_wins, avg(net) FILTER (mature AND settled) AS m FROM c2 GROUP BY ALL),
cohort AS MATERIALIZED (SELECT * EXCLUDE (m), matured - resolved AS missing, resolved - hits AS misses, CASE WHEN resolved > 0 AND matured = resolved THEN hits / resolved END AS hit_rate, CASE WHEN resolved > 0 AND matured = resolved THEN {_wilson('hits', 'resolved', '-')} END AS low, CASE WHEN resolved > 0 AND matured = resolved THEN {_wilson('hits', 'resolved', '+')} END AS high,
  CASE WHEN resolved > 0 AND matured = resolved AND net_n = resolved THEN net_wins / net_n END AS net_win_rate, CASE WHEN resolved > 0 AND matured = resolved AND net_n = resolved THEN m END AS mean_net FROM c3)"""


@query(f"WITH {COHORTS} SELECT * REPLACE (round(hit_rate, 9) AS hit_rate, round(low, 9) AS low, round(high, 9) AS high, round(net_win_rate, 9) AS net_win_rate, round(mean_net, 6) AS mean_net) FROM cohort")
def cohort_measures(spark, sf):
    """Cohorts by audience, horizon, direction, regime, strategy, policy, symbol and family."""
    return rounded(rounded(lg.cohorts(signals(spark, sf), NOW), 9, "hit_rate", "low", "high", "net_win_rate"), 6, "mean_net")


@query(f"""WITH {COHORTS}, x AS (SELECT * EXCLUDE (family), unnest(families) AS family FROM ledger)
SELECT x.id, round(min(hit_rate), 9) AS least_rate, min(resolved) AS least_resolved FROM x LEFT JOIN cohort c ON c.audience = 'all' AND c.family = x.family AND c.horizon = x.horizon AND c.direction = x.direction AND c.regime = x.regime AND c.strategy = x.strategy AND c.policy = x.policy AND c.symbol = x.symbol GROUP BY x.id""")
def cohort_lookup(spark, sf):
    """Every signal with the least favourable rate over its families' cohorts."""
    l = signals(spark, sf)
    return rounded(lg.cohort_lookup(l, lg.cohorts(l, NOW)), 9, "least_rate")


#: Items: each symbol's newest signal, judged by everything that settled.
ITEMS = "items AS (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_ms DESC, id DESC) = 1)"
FORECAST = LEDGER + f""", {ITEMS}, hz AS (SELECT items.id, items.symbol, items.regime, unnest(items.families) AS family FROM items), h3 AS (SELECT hz.*, h::INT AS horizon FROM hz, (VALUES (15), (30), (60)) v(h)),
net AS (SELECT *, coalesce(net, gross - cost, gross) AS n_ FROM ledger),
f0 AS (SELECT family, horizon, symbol, regime, count(*) AS n0, avg(CAST(gross > 0 AS INT)) AS p0, quantile_cont(gross, 0.5) AS g0, quantile_cont(n_, 0.5) AS t0 FROM net GROUP BY ALL),
f1 AS (SELECT family, horizon, regime, count(*) AS n1, avg(CAST(gross > 0 AS INT)) AS p1, quantile_cont(gross, 0.5) AS g1, quantile_cont(n_, 0.5) AS t1 FROM net GROUP BY ALL),
f2 AS (SELECT family, horizon, count(*) AS n2, avg(CAST(gross > 0 AS INT)) AS p2, quantile_cont(gross, 0.5) AS g2, quantile_cont(n_, 0.5) AS t2 FROM net GROUP BY ALL),
fj AS (SELECT h3.*, * EXCLUDE (family, horizon, symbol, regime, id), CASE WHEN n0 >= 10 THEN 0 WHEN n1 >= 10 THEN 1 ELSE 2 END::INT AS level FROM h3 LEFT JOIN f0 USING (family, horizon, symbol, regime) LEFT JOIN f1 USING (family, horizon, regime) LEFT JOIN f2 USING (family, horizon)),
forecast AS (SELECT id, symbol, regime, family, horizon, level, CASE level WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END AS n, CASE level WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS p_up, CASE level WHEN 0 THEN g0 WHEN 1 THEN g1 ELSE g2 END AS median_gross, CASE level WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END AS median_net FROM fj)"""


def newest(ledger):
    return lg.latest_of(ledger, ("symbol",), F.desc("bar_ms"), F.desc("id"))


def forecast_frame(ledger):
    return lg.forecasts(newest(ledger).select("id", "symbol", "regime", F.explode("families").alias("family")), ledger)


@query(f"WITH {FORECAST} SELECT * REPLACE (round(p_up, 9) AS p_up) FROM forecast WHERE n IS NOT NULL")
def setup_forecasts(spark, sf):
    """Forecasts of each symbol's newest signal by family and horizon, with fallback histories."""
    return rounded(forecast_frame(signals(spark, sf)), 9, "p_up")


_LABEL = "CASE WHEN p >= 0.55 AND t > 0 THEN 'UP' WHEN p <= 0.45 AND -g - greatest(g - t, 0) > 0 THEN 'DOWN' ELSE 'MIXED' END"


@query(f"""WITH {FORECAST}, a AS (SELECT *, p_up AS p, median_gross AS g, median_net AS t FROM forecast WHERE n IS NOT NULL), b AS (SELECT *, {_LABEL} AS label FROM a),
c AS (SELECT id, horizon, sum(n * p_up) / sum(n) AS p, sum(n * median_gross) / sum(n) AS g, sum(n * median_net) / sum(n) AS t, count(DISTINCT label) AS kinds FROM b GROUP BY ALL), d AS (SELECT *, {_LABEL} AS label FROM c)
SELECT id, string_agg(label, '/' ORDER BY horizon) AS labels, max(kinds) = 1 AS families_agree, CASE WHEN count(DISTINCT label) = 1 THEN min(label) ELSE 'MIXED' END AS direction FROM d GROUP BY id""")
def setup_directions(spark, sf):
    """Labels by horizon and the consensus direction of each newest signal."""
    return lg.setup_directions(forecast_frame(signals(spark, sf)), "id")


@query(f"""WITH {LEDGER}, {ITEMS}, one AS (SELECT id, symbol, regime, direction = 'LONG' AS up, strategy, unnest(families) AS family, CASE WHEN strategy IN ('BULL_EXHAUSTION_SHORT', 'DOWNSIDE_CONTINUATION_SHORT') THEN 30 ELSE 60 END AS horizon FROM items),
lev AS (SELECT one.*, (SELECT count(*) FROM ledger l WHERE l.family = one.family AND l.horizon = one.horizon AND l.symbol = one.symbol AND l.regime = one.regime) AS n0, (SELECT count(*) FROM ledger l WHERE l.family = one.family AND l.horizon = one.horizon AND l.regime = one.regime) AS n1 FROM one),
ev AS (SELECT lev.id, l.symbol, l.bar_ms, min(CASE WHEN up THEN gross - cost ELSE -gross - cost END) AS net, list(DISTINCT settled_ms // {DAY}) AS ds FROM lev JOIN ledger l ON l.family = lev.family AND l.horizon = lev.horizon AND (n0 < 10 OR (l.symbol = lev.symbol AND l.regime = lev.regime)) AND (n0 >= 10 OR n1 < 10 OR l.regime = lev.regime) GROUP BY ALL),
g AS (SELECT id, count(*) AS n, count(*) FILTER (net > 0) AS wins, avg(net) AS e, len(list_distinct(flatten(list(ds)))) AS days FROM ev GROUP BY id)
SELECT id, n, days::INT AS days, round((wins + 1) / (n + 2), 9) AS probability, round(e, 6) AS expected_net, CASE WHEN n < 30 OR days < 3 THEN 'LOW' WHEN n < 100 OR days < 10 THEN 'MID' ELSE 'HIGH' END AS confidence FROM g""")
def setup_assessments(spark, sf):
    """Probability, expected net and confidence of each newest signal at its strategy's horizon."""
    l = signals(spark, sf)
    items = newest(l).select("id", "symbol", "regime", "families", (F.col("direction") == "LONG").alias("up"), "strategy")
    return rounded(rounded(lg.assessments(items, l), 9, "probability"), 6, "expected_net")


@query(f"""WITH {LEDGER}, past AS (SELECT family, regime, score FROM ledger WHERE bar_ms < {NOW}), i AS (SELECT id, unnest(list_distinct(families)) AS family, regime, score + id % 3 * 0.0035 - 0.003 AS score FROM ledger),
c AS (SELECT i.id, i.family, CASE WHEN count(p.score) >= 10 THEN count(*) FILTER (p.score <= i.score) / count(p.score) END AS share FROM i LEFT JOIN past p ON p.family = i.family AND p.regime = i.regime GROUP BY ALL)
SELECT id, round(avg(share), 9) AS percentile FROM c GROUP BY id""")
def quality_percentile(spark, sf):
    """Every signal, most with a score that the past has not seen, ranked within its families and regime."""
    l = signals(spark, sf)
    items = l.select("id", "families", "regime", (F.col("score") + F.col("id") % 3 * 0.0035 - 0.003).alias("score"))
    return rounded(lg.quality_percentiles(items, l.where(F.col("bar_ms") < NOW).select("family", "regime", "score")), 9, "percentile")


@query(f"""WITH {LEDGER}, r AS (SELECT *, CASE WHEN notified THEN 'TRADE' ELSE 'WATCH' END AS tier, symbol || '_' || horizon AS model FROM ledger WHERE status IS NOT NULL AND {NOW} - settled_ms <= {400 * DAY}),
g AS (SELECT 'overall' AS kind, 'all' AS "group", * FROM r UNION ALL SELECT 'tier', tier, * FROM r UNION ALL SELECT 'model', model, * FROM r)
SELECT kind, "group", count(*) AS n, round(avg(CAST(status = 'TARGET' AS INT)), 9) AS hit_rate, round(avg(gross), 6) AS gross, round(avg(net), 6) AS net, round(sum(net), 4) AS total_net FROM g GROUP BY ALL UNION ALL SELECT 'tier', 'EMPTY', 0, 0, 0, 0, 0""")
def scorecard_levels(spark, sf):
    """Overall, by tier and by model over the last 400 days; a tier without rows is zeros."""
    r = lg.scorecard_days(signals(spark, sf), NOW, 400, ("TRADE", "WATCH"))
    zero = spark.createDataFrame([("tier", "EMPTY", 0, 0.0, 0.0, 0.0, 0.0)], r.schema)
    return rounded(rounded(rounded(r.unionByName(zero), 9, "hit_rate"), 6, "gross", "net"), 4, "total_net")


@query(f"""WITH {LEDGER}, r AS (SELECT * FROM ledger WHERE policy = (SELECT policy FROM ledger ORDER BY bar_ms DESC, id DESC LIMIT 1))
SELECT family, horizon, regime, strategy, count(DISTINCT id) AS signals, count(status) AS outcomes, count(*) FILTER (status IS NULL) AS missing, count(*) FILTER (notified) AS notified, count(*) FILTER (status = 'TARGET') AS hits, round(sum(net), 4) AS total_net FROM r GROUP BY GROUPING SETS ((family, horizon), (regime), (strategy), ())""")
def family_scorecard(spark, sf):
    """Outcomes by family and horizon, regime and strategy under the newest policy."""
    return rounded(lg.family_scorecard(signals(spark, sf)), 4, "total_net")


EXEC = LEDGER + """, x0 AS (SELECT *, spread_bps IS NOT NULL AS known, CASE WHEN spread_bps IS NULL THEN 12.0 ELSE greatest(12.0, 8 + spread_bps + 2) END AS estimated_cost,
  CASE WHEN spread_bps IS NULL THEN ['market_data_missing'] ELSE list_filter([CASE WHEN spread_bps > 8 THEN 'spread' END, CASE WHEN quote_volume < 1000000 THEN 'liquidity' END, CASE WHEN abs(funding_bps) > 15 THEN 'funding' END, CASE WHEN volatility_bps > 100 THEN 'volatility' END], lambda v: v IS NOT NULL) END AS reasons FROM ledger),
exec AS (SELECT *, len(reasons) = 0 AS eligible, CASE WHEN len(reasons) = 0 AND (len(families) >= 2 OR list_contains(families, 'B2')) AND regime IN ('BULL', 'TRANSITION') THEN 'SETUP' ELSE 'RADAR' END AS tier FROM x0)"""


@query(f"WITH {EXEC} SELECT id, round(estimated_cost, 6) AS estimated_cost, array_to_string(reasons, ',') AS reasons, eligible, tier FROM exec")
def execution_gates(spark, sf):
    """Estimated cost, eligibility, tier and reasons of every signal."""
    r = lg.execution(signals(spark, sf))
    return rounded(r.select("id", "estimated_cost", F.array_join("reasons", ",").alias("reasons"), "eligible", "tier"), 6, "estimated_cost")


LIMITS = (("BULL", True, 1.0, 0.2, 0.4, -40.0), ("TRANSITION", True, 0.5, 0.3, 0.42, -50.0), ("OFF", False, 2.0, 0.5, 0.5, 0.0))
CANDIDATES = EXEC + """, cand AS (SELECT *, CASE WHEN id % 7 <> 0 THEN (id % 60)::BIGINT END AS n, CASE WHEN id % 19 <> 0 THEN (id % 100) / 100.0 END AS probability, CAST(gross AS DOUBLE) / 4 AS expected_net, CASE WHEN id % 6 <> 0 THEN (id % 50) / 50.0 END AS percentile FROM exec),
th(regime, enabled, t_score, t_percentile, t_probability, t_net) AS (VALUES """ + ", ".join(f"('{r}', {e}, {s}, {q}, {p}, {n})" for r, e, s, q, p, n in LIMITS) + """),
th2 AS (SELECT a.regime, a.enabled, greatest(a.t_score, b.t_score) AS s, greatest(a.t_percentile, b.t_percentile) AS q, greatest(a.t_probability, b.t_probability) AS p, greatest(a.t_net, b.t_net) AS e FROM th a, th b WHERE b.regime = 'BULL'),
judged AS (SELECT cand.*, CASE WHEN NOT enabled THEN ['off_disabled'] WHEN NOT list_has_any(families, ['F1', 'F2', 'B1', 'B2']) THEN ['shadow_only_family'] WHEN len(reasons) > 0 THEN reasons WHEN tier <> 'SETUP' THEN ['no_setup']
  WHEN n >= 30 AND (probability IS NULL OR expected_net IS NULL) THEN ['calibration_missing'] WHEN n >= 30 AND probability < p THEN ['probability_low'] WHEN n >= 30 AND expected_net < e THEN ['expected_net_low'] WHEN n >= 30 AND percentile IS NULL AND score < s THEN ['score_low'] WHEN n >= 30 AND percentile < q THEN ['quality_low']
  WHEN NOT coalesce(n >= 30, FALSE) AND score < s THEN ['score_low'] ELSE ['eligible'] END AS why FROM cand JOIN th2 USING (regime))"""


def judged(spark, sf):
    c = lg.execution(signals(spark, sf)).withColumns({"n": F.when(F.col("id") % 7 != 0, F.col("id") % 60), "probability": F.when(F.col("id") % 19 != 0, (F.col("id") % 100) / 100.0), "expected_net": F.col("gross") / 4, "percentile": F.when(F.col("id") % 6 != 0, (F.col("id") % 50) / 50.0)})
    limits = spark.createDataFrame(list(LIMITS), "regime string, enabled boolean, score double, percentile double, probability double, net double")
    return lg.notification_reasons(c, limits, ("F1", "F2", "B1", "B2"))


@query(f"WITH {CANDIDATES} SELECT id, array_to_string(why, ',') AS why FROM judged")
def notification_gates(spark, sf):
    """The first failing gate of each candidate (market data may give several), thresholds by regime never below BULL's."""
    return judged(spark, sf).select("id", F.array_join("why", ",").alias("why"))


@query(f"WITH {CANDIDATES}, names AS (SELECT unnest([{', '.join(repr(x) for x in lg.REASONS)}]) AS reason), g AS (SELECT unnest(why) AS reason FROM judged) SELECT names.reason, count(g.reason) AS n FROM names LEFT JOIN g USING (reason) GROUP BY ALL")
def notification_funnel(spark, sf):
    """Counts of candidates by reason, zeros too."""
    return lg.reason_counts(judged(spark, sf))


#: (name, kill switch, most open alerts, loss limit) of the cases that the safety gates are asked.
SAFETY = (("calm", False, 50, 100_000.0), ("no_limit", False, 50, 0.0), ("one_open", False, 1, 0.0), ("strict", False, 50, 1.0), ("kill", True, 50, 0.0))


@query(f"""WITH {LEDGER}, times AS (SELECT max(bar_ms) + 60000 AS now FROM ledger, (VALUES ({NOW}), ({NOW + 500 * DAY})) x(t) WHERE notified AND bar_ms <= t GROUP BY t), cand AS (SELECT now, id, symbol, direction, score FROM ledger JOIN times ON bar_ms BETWEEN now - {20 * DAY} AND now),
sent AS (SELECT now, symbol, max({{'t': bar_ms, 'direction': direction, 'score': score}}) AS last FROM ledger JOIN times ON bar_ms <= now WHERE notified GROUP BY ALL),
tot AS (SELECT now, count(*) FILTER ((status IS NULL OR settled_ms > now) AND bar_ms + least(horizon, 60) * 60000 BETWEEN now + 1 AND now + 3600000) AS open, coalesce(sum(net) FILTER (settled_ms BETWEEN now - now % {DAY} AND now), 0) AS today FROM ledger CROSS JOIN times WHERE notified GROUP BY now),
cases("case", kill, most, lim) AS (VALUES {', '.join(f"('{n}', {str(k).upper()}, {m}, {x})" for n, k, m, x in SAFETY)})
SELECT "case", now, id, cand.symbol, cand.direction, score, CASE WHEN kill THEN 'kill_switch' WHEN open >= most THEN 'max_open' WHEN lim > 0 AND today <= -lim THEN 'daily_loss' WHEN cand.direction = last.direction AND now - last.t < {10 * DAY} AND score < last.score + 0.5 THEN 'cooldown' END AS blocked
FROM cand JOIN tot USING (now) CROSS JOIN cases LEFT JOIN sent USING (now, symbol)""")
def safety_gates(spark, sf):
    """The safety gates a minute after two alerts: open alerts, the day's loss (no limit at zero) and the cooldown with a score override."""
    l = signals(spark, sf)
    times = [l.where(F.col("notified") & (F.col("bar_ms") <= t)).agg(F.max("bar_ms") + 60_000).first()[0] for t in (NOW, NOW + 500 * DAY)]
    out = None
    for now in times:
        sent = l.where(F.col("notified") & (F.col("bar_ms") <= now)).select("symbol", "direction", "score", F.col("bar_ms").alias("sent_ms"))
        c = l.where(F.col("bar_ms").between(now - 20 * DAY, now)).select("id", "symbol", "direction", "score")
        for name, kill, most, limit in SAFETY:
            r = lg.safety(c, l, sent, now, kill, most, limit, 10 * DAY, 0.5).select(F.lit(name).alias("case"), F.lit(now).alias("now"), "*")
            out = r if out is None else out.unionByName(r)
    return out


ARMS = LEDGER + """, arm AS (SELECT 'baseline' AS arm, * FROM ledger WHERE score >= 2 UNION ALL SELECT 'proposed', * FROM ledger WHERE score >= 1 AND len(families) >= 1 UNION ALL SELECT 'additional', * FROM ledger WHERE score >= 1 AND score < 2)"""


@query(f"""WITH {ARMS}, g AS (SELECT arm, count(*) AS mature, count(status) AS resolved, count(*) FILTER (status = 'TARGET') AS wins, avg(net) FILTER (status IS NOT NULL) AS m FROM arm WHERE settled_ms <= {NOW} GROUP BY arm)
SELECT arm, mature, resolved, mature - resolved AS missing, CASE WHEN mature = resolved THEN wins / mature END AS rate, CASE WHEN mature = resolved THEN round(m, 6) END AS mean_net FROM g""")
def arm_comparison(spark, sf):
    """Baseline, proposed and additional candidates (the keys that only the proposed arm has) against the outcomes."""
    l = signals(spark, sf)
    base, more = l.where("score >= 2"), l.where("score >= 1")
    extra = more.join(base.select("id"), "id", "left_anti")
    arms = [x.select(F.lit(n).alias("arm"), "id", F.col("settled_ms").alias("due")) for n, x in (("baseline", base), ("proposed", more), ("additional", extra))]
    done = l.where("status is not null").select("id", (F.col("status") == "TARGET").alias("won"), "net")
    return rounded(lg.arm_metrics(arms[0].unionByName(arms[1]).unionByName(arms[2]), done, NOW), 6, "mean_net")


@query(f"""WITH {LEDGER}, g AS (SELECT strategy, count(*) AS signals, count(status) AS settled, count(*) FILTER (status = 'TARGET') AS wins, count(*) FILTER (status IN ('TARGET', 'STOP')) AS decided, count(DISTINCT CASE WHEN status IS NOT NULL THEN bar_ms // {DAY} END) AS days, avg(net) FILTER (status IS NOT NULL) AS m FROM ledger GROUP BY strategy)
SELECT strategy, signals, settled, wins, decided, days, round(m, 6) AS mean_net, round(wins / nullif(decided, 0), 9) AS win_rate, round(m - 18, 6) AS stress_net, CASE WHEN settled < 100 OR days < 15 THEN 'TOO_FEW' WHEN m <= 0 OR wins / decided < 0.5 THEN 'FAILED' WHEN m - 18 > 0 THEN 'PASSED' ELSE 'UNDECIDED' END AS verdict FROM g""")
def experiment_verdicts(spark, sf):
    """Forward-experiment summary and verdict by strategy."""
    r = lg.verdicts(signals(spark, sf), "strategy", started_ms=NOW - 30 * DAY, now_ms=NOW, break_even=0.5)
    return rounded(rounded(r, 6, "mean_net", "stress_net"), 9, "win_rate")


@query(f"""WITH {LEDGER}, x AS (SELECT *, level, direction || ':' || array_to_string(families, '+') AS setup, CASE WHEN status IS NOT NULL THEN gross >= level * 50 END AS hit FROM ledger, (VALUES (2), (3), (5)) v(level))
SELECT strategy, regime, setup, {', '.join(f'count(*) FILTER (level = {k} AND hit) AS "{k}_hits", count(*) FILTER (level = {k} AND NOT hit) AS "{k}_misses", count(*) FILTER (level = {k} AND hit IS NULL) AS "{k}_pending"' for k in (2, 3, 5))}, count(DISTINCT id) AS signals, count(DISTINCT CAST(timezone('Europe/Istanbul', make_timestamptz(bar_ms * 1000)) AS DATE)) AS days FROM x GROUP BY ALL""")
def dashboard_pivot(spark, sf):
    """Hits, misses and pending by strategy, regime and setup, a column for each level; local days."""
    return lg.pivot_levels(signals(spark, sf))


@query(f"""WITH {EXEC}, b AS (SELECT symbol, min({{'a': tier <> 'SETUP', 'b': NOT eligible, 'c': -score, 'd': symbol, 'e': family, 'f': id}}) AS p FROM exec GROUP BY symbol ORDER BY p LIMIT 12) SELECT id, symbol, tier, eligible, score FROM exec WHERE symbol IN (SELECT symbol FROM b)""")
def report_top_symbols(spark, sf):
    """All observations of the twelve best symbols."""
    return lg.top_symbols(lg.execution(signals(spark, sf)), 12).select("id", "symbol", "tier", "eligible", "score")


@query(f"""WITH {LEDGER}, b AS (SELECT * FROM ledger WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY score DESC, id) = 1) SELECT id, symbol, score FROM b ORDER BY score DESC, symbol LIMIT 5""")
def status_candidates(spark, sf):
    """The five best symbols by their best clear observation."""
    return lg.best_of_each(signals(spark, sf).withColumn("clear", F.col("status").isNotNull()), 5).select("id", "symbol", "score")


@query(f"""WITH {LEDGER}, p AS (SELECT id, unnest([{{'name': 'gross', 'value': gross}}, {{'name': 'cost', 'value': -cost}}, {{'name': 'funding_bps', 'value': funding_bps}}, {{'name': 'volatility_bps', 'value': volatility_bps}}, {{'name': 'score', 'value': score}}]) AS x FROM ledger)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY abs(x.value) DESC, x.name) - 1)::INT AS place, x.name AS name, x.value AS value FROM p QUALIFY place < 4""")
def top_contributions(spark, sf):
    """The four parts of largest absolute value of every signal."""
    return lg.top_contributions(signals(spark, sf).withColumn("cost", -F.col("cost")), ("gross", "cost", "funding_bps", "volatility_bps", "score"))


@query(f"""WITH {LEDGER}, t AS (SELECT bar_ms // {91 * DAY} AS fold, strategy AS variant, avg(net) AS mean_net, count(*) >= 20 AND avg(net) > 0 AS eligible FROM ledger GROUP BY ALL), f AS (SELECT DISTINCT fold FROM t), b AS (SELECT * FROM t WHERE eligible QUALIFY row_number() OVER (PARTITION BY fold ORDER BY mean_net DESC, variant) = 1)
SELECT fold, variant, round(mean_net, 6) AS mean_net FROM f LEFT JOIN b USING (fold)""")
def best_variants(spark, sf):
    """Each quarter's best variant by training mean among the eligible; none where none is."""
    t = signals(spark, sf).groupBy(F.floor(F.col("bar_ms") / (91 * DAY)).cast("long").alias("fold"), F.col("strategy").alias("variant")).agg(F.avg("net").alias("mean_net"), ((F.count("*") >= 20) & (F.avg("net") > 0)).alias("eligible"))
    return rounded(lg.best_variant(t, t.select("fold").distinct(), "fold"), 6, "mean_net")


@query(f"""WITH {LEDGER}, u AS (SELECT 'target' AS kind, id, status = 'TARGET' AS success, net, NULL AS score, 1 AS i FROM ledger WHERE status IS NOT NULL AND id % 2 = 0 UNION ALL SELECT 'target', id, NULL, NULL, score, 2 FROM ledger WHERE id % 3 = 0 UNION ALL SELECT 'bracket', id, net > 0, net, score, 0 FROM ledger WHERE id % 5 = 0)
SELECT kind, id, success, net, score FROM u QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY CASE WHEN success IS NOT NULL THEN 0 ELSE 1 END, i DESC) = 1""")
def signal_union(spark, sf):
    """Brackets, settled targets and pending targets in one table; settled rows win."""
    l = signals(spark, sf)
    brackets = l.where("id % 5 = 0").select(F.lit("bracket").alias("kind"), "id", (F.col("net") > 0).alias("success"), "net", "score")
    settled = l.where("status is not null and id % 2 = 0").select(F.lit("target").alias("kind"), "id", (F.col("status") == "TARGET").alias("success"), "net")
    pending = l.where("id % 3 = 0").select(F.lit("target").alias("kind"), "id", F.lit(None).cast("boolean").alias("success"), "score")
    return lg.ranked_union([brackets, settled, pending], ("kind", "id")).select("kind", "id", "success", "net", "score")


@query(f"""WITH {LEDGER}, s AS (SELECT 0 AS source_no, id, gross AS value FROM ledger WHERE id % 2 = 0 UNION ALL SELECT 1, id, net FROM ledger WHERE id % 3 = 0 UNION ALL SELECT 2, id, score FROM ledger)
SELECT id, source_no::INT AS source_no, value FROM s WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY source_no) = 1""")
def first_valid_source(spark, sf):
    """The first of three sources that gives a positive value."""
    l = signals(spark, sf)
    s = [l.where("id % 2 = 0").select("id", F.col("gross").alias("value")), l.where("id % 3 = 0").select("id", F.col("net").alias("value")), l.select("id", F.col("score").alias("value"))]
    return lg.first_valid(s, ("id",), F.col("value") > 0).select("id", "source_no", "value")


@query(f"""WITH {LEDGER} SELECT id, sha256(symbol || '|' || bar_ms || '|' || family) AS signal_id, strftime(timezone('Europe/Istanbul', make_timestamptz(bar_ms * 1000)), '%d.%m.%Y %H:%M') AS local_time, CAST(bar_ms + (horizon / 60.0) * 3600000 AS BIGINT) AS due, -gross - greatest(gross - net, 0) AS short_net, CAST(greatest(1, round_even(horizon / 60.0 * 12, 0)) AS BIGINT) AS candles,
  round(0.5 + cost / (2 * 150.0), 9) AS break_even, try_cast(CASE WHEN id % 9 = 0 THEN 'nan' WHEN id % 9 = 1 THEN 'x' ELSE CAST(gross AS VARCHAR) END AS DOUBLE) AS raw FROM ledger""".replace("try_cast(CASE WHEN id % 9 = 0 THEN 'nan' WHEN id % 9 = 1 THEN 'x' ELSE CAST(gross AS VARCHAR) END AS DOUBLE) AS raw", "CASE WHEN id % 9 > 1 THEN gross END AS raw"))
def scalar_functions(spark, sf):
    """Identifiers, local time, deadlines, short net, candle counts, break-even rate and safe numbers of every signal."""
    text = F.when(F.col("id") % 9 == 0, "nan").when(F.col("id") % 9 == 1, "x").otherwise(F.col("gross").cast("string"))
    return signals(spark, sf).select(
        "id", lg.signal_id(F.col("symbol"), F.col("bar_ms"), F.col("family")).alias("signal_id"), F.date_format(F.from_utc_timestamp(F.timestamp_millis("bar_ms"), "Europe/Istanbul"), "dd.MM.yyyy HH:mm").alias("local_time"),
        lg.deadline(F.col("bar_ms"), F.col("horizon") / 60).alias("due"), lg.short_net(F.col("gross"), F.col("net")).alias("short_net"), F.greatest(F.lit(1), F.bround(F.col("horizon") / 60 * 12)).cast("long").alias("candles"),
        F.round(0.5 + F.col("cost") / (2 * 150.0), 9).alias("break_even"), lg.finite(text).alias("raw"))


@query(f"""WITH {EXEC}, g AS (SELECT symbol, bar_ms // {DAY} AS day, quantile_cont(volatility_bps, 0.5) FILTER (volatility_bps > 0) AS v, max(estimated_cost) AS c FROM exec GROUP BY ALL)
SELECT symbol, day, least(greatest(9 * coalesce(v, 25), 6 * c, 180), 300) AS target_bps, least(greatest(6 * coalesce(v, 25), 4 * c, 120), 200) AS stop_bps FROM g""")
def dynamic_brackets(spark, sf):
    """Targets and stops from the median volatility and the largest cost of each symbol's day."""
    v, c = F.coalesce("v", F.lit(25.0)), F.col("c")
    g = lg.execution(signals(spark, sf)).groupBy("symbol", F.floor(F.col("bar_ms") / DAY).cast("long").alias("day")).agg(F.percentile(F.when(F.col("volatility_bps") > 0, F.col("volatility_bps")), 0.5).alias("v"), F.max("estimated_cost").alias("c"))
    return g.select("symbol", "day", F.least(F.greatest(9 * v, 6 * c, F.lit(180.0)), F.lit(300.0)).alias("target_bps"), F.least(F.greatest(6 * v, 4 * c, F.lit(120.0)), F.lit(200.0)).alias("stop_bps"))


@query(f"""WITH {LEDGER}, g AS (SELECT symbol, bar_ms // {7 * DAY} AS week, family, id, horizon FROM ledger QUALIFY row_number() OVER (PARTITION BY symbol, bar_ms // {7 * DAY}, family ORDER BY CASE WHEN horizon = 15 THEN 0 ELSE 1 END, id) = 1),
s AS (SELECT symbol, week, list_sort(list(family)) AS fs FROM g GROUP BY ALL)
SELECT arm, count(*) AS n, count(DISTINCT symbol) AS symbols FROM (SELECT *, unnest(list_filter([CASE WHEN len(fs) >= 2 THEN 'MULTI' END, 'ALL', CASE WHEN list_contains(fs, 'F2') THEN 'CONTINUATION' END, CASE WHEN list_has_any(fs, ['F1', 'F3']) AND NOT list_contains(fs, 'F2') THEN 'FADE' END], lambda v: v IS NOT NULL)) AS arm FROM s) GROUP BY arm""")
def family_set_arms(spark, sf):
    """Signals grouped by symbol and week, one row for each family (15-minute rows first), counted by arm of their family set."""
    r = signals(spark, sf).withColumn("week", F.floor(F.col("bar_ms") / (7 * DAY)).cast("long"))
    one = lg.latest_of(r, ("symbol", "week", "family"), (F.col("horizon") == 15).desc(), F.col("id"))
    s = one.groupBy("symbol", "week").agg(F.sort_array(F.collect_list("family")).alias("fs"))
    has = lambda *f: F.arrays_overlap("fs", F.array(*map(F.lit, f)))
    arms = F.array_compact(F.array(F.when(F.size("fs") >= 2, "MULTI"), F.lit("ALL"), F.when(has("F2"), "CONTINUATION"), F.when(has("F1", "F3") & ~has("F2"), "FADE")))
    return s.withColumn("arm", F.explode(arms)).groupBy("arm").agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"))


@query(f"""WITH {LEDGER}, t AS (SELECT *, CASE WHEN id % 10 < 3 THEN 'c1' ELSE 'c2' END AS config FROM ledger) SELECT sha256('{{"arm":"' || config || '","limit":' || CASE config WHEN 'c1' THEN 5 ELSE 9 END || '}}') AS profile_id, count(*) AS n, count(status) AS settled, min(bar_ms) AS started_ms FROM t GROUP BY ALL""")
def experiment_profiles(spark, sf):
    """Isolated profiles by the hash of their configuration; old ones keep settling."""
    r = signals(spark, sf).withColumn("config", F.when(F.col("id") % 10 < 3, F.struct(F.lit("c1").alias("arm"), F.lit(5).alias("limit"))).otherwise(F.struct(F.lit("c2").alias("arm"), F.lit(9).alias("limit"))))
    return r.groupBy(F.sha2(F.to_json("config"), 256).alias("profile_id")).agg(F.count("*").alias("n"), F.count("status").alias("settled"), F.min("bar_ms").alias("started_ms"))
