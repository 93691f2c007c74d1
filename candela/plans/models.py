"""Registered feature, label, calibration, split and selection queries with their DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from candela.operators import fits as ft
from candela.operators import market as mk
from candela.operators import models as md
from candela.plans.catalog import DAY, query, rounded
from candela.plans.ledgers import LEDGER, _wilson
from candela.plans.market import CALM, P, _ewm, _full, calm, lag
from candela.sources import files as fs
from candela.sources.ledger import signals

FEAT = CALM + f""",
g0 AS (SELECT *, greatest(high - low, abs(high - {lag('close', 1)}), abs(low - {lag('close', 1)})) AS tr, CASE WHEN {lag('close', 1)} IS NOT NULL THEN greatest(close - {lag('close', 1)}, 0) END AS gain, CASE WHEN {lag('close', 1)} IS NOT NULL THEN greatest({lag('close', 1)} - close, 0) END AS loss, ln(1 + volume) AS lv FROM bars),
{_ewm('ge', 'g0', {'atr': ('tr', '(1.0 / 14)'), 'eg': ('gain', '(1.0 / 14)'), 'el': ('loss', '(1.0 / 14)'), 'e8': ('close', '(2.0 / 9)'), 'e21': ('close', '(2.0 / 22)')})},
g1 AS (SELECT g0.*, rn, CASE WHEN rn >= 14 THEN ge.atr END AS atr, CASE WHEN rn >= 15 THEN CASE WHEN eg = 0 THEN 0 WHEN el = 0 THEN 100 ELSE 100 - 100 / (1 + eg / el) END END AS rsi, CASE WHEN rn >= 21 THEN e8 - e21 END AS spread, CASE WHEN rn >= 14 THEN greatest(ge.atr / close, 1e-9) END AS safe FROM g0 JOIN ge USING (symbol, open_time_ms)),
feat AS MATERIALIZED (SELECT *, {', '.join(f"ln(close / {lag('close', k)}) / safe AS momentum_{k}" for k in (1, 3, 12))}, spread / nullif(atr, 0) AS ema_spread, (rsi - 50) / 25 AS rsi_centred, (close - {_full('avg({x})', 'close', 19)}) / nullif({_full('stddev_pop({x})', 'close', 19)}, 0) AS bollinger_z, ln(safe) AS log_atr_pct,
  (lv - {_full('avg({x})', 'lv', 19)}) / nullif({_full('stddev_pop({x})', 'lv', 19)}, 0) AS volume_z, (2 * close - high - low) / nullif(high - low, 0) AS pressure, atr / close AS atr_pct FROM g1)"""
NAMES = ", ".join(mk.FEATURES)


@query(f"WITH RECURSIVE {FEAT} SELECT symbol, open_time_ms, round(atr, 6) AS atr, {', '.join(f'round({c}, 5) AS {c}' for c in mk.FEATURES)} FROM feat")
def feature_frame(spark, sf):
    """The nine model features of every candle."""
    r = mk.feature_frame(calm(spark, sf)).select("symbol", "open_time_ms", "atr", *mk.FEATURES)
    return rounded(rounded(r, 6, "atr"), 5, *mk.FEATURES)


def label_sql(h: int = 12, name: str = "lab", floor: int = 50, more: str = "") -> str:
    """Labels with a horizon of ``h`` rows, as the table ``name``; ``more``: further columns."""
    return f"""{name}_b0 AS (SELECT *, greatest(1.0 * atr_pct * 10000, {floor}) AS barrier_bps FROM feat),
{name}_b1 AS (SELECT a.symbol, a.open_time_ms, min(b.rn - a.rn) FILTER (b.high >= a.close * exp(a.barrier_bps / 10000)) AS u, min(b.rn - a.rn) FILTER (b.low <= a.close * exp(-a.barrier_bps / 10000)) AS d, ln(max(b.close) FILTER (b.rn - a.rn = {h}) / any_value(a.close)) * 10000 AS timeout_bps FROM {name}_b0 a JOIN {name}_b0 b ON b.symbol = a.symbol AND b.rn > a.rn AND b.rn <= a.rn + {h} GROUP BY ALL HAVING count(*) = {h}),
{name}_b2 AS (SELECT {name}_b0.*, u, d, timeout_bps, CASE WHEN u IS NULL AND d IS NULL THEN 'NONE' WHEN u = d THEN 'BOTH' WHEN d IS NULL OR u < d THEN 'UP' ELSE 'DOWN' END AS touch FROM {name}_b0 JOIN {name}_b1 USING (symbol, open_time_ms) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in mk.FEATURES)}),
{name} AS MATERIALIZED (SELECT symbol, open_time_ms, close, {NAMES}, barrier_bps, touch, least(coalesce(u, {h}), coalesce(d, {h}))::INT AS exit_offset, timeout_bps, CASE touch WHEN 'UP' THEN 1 WHEN 'DOWN' THEN 0 ELSE CAST(timeout_bps > 0 AS INT) END::INT AS target,
  CASE touch WHEN 'UP' THEN barrier_bps WHEN 'NONE' THEN timeout_bps ELSE -barrier_bps END - 10 AS long_net, CASE touch WHEN 'DOWN' THEN barrier_bps WHEN 'NONE' THEN -timeout_bps ELSE -barrier_bps END - 10 AS short_net{more} FROM {name}_b2 QUALIFY count(*) OVER (PARTITION BY symbol) >= 200)"""


LABEL = FEAT + ",\n" + label_sql()
_L = ("barrier_bps", "timeout_bps", "long_net", "short_net")


def labels(spark, sf):
    return mk.supervised(calm(spark, sf), floor_bps=50.0)


@query(f"WITH RECURSIVE {LABEL} SELECT symbol, open_time_ms, touch, exit_offset, target, {', '.join(f'round({c}, 5) AS {c}' for c in _L)} FROM lab")
def supervised_labels(spark, sf):
    """Triple-barrier labels with ATR barriers, joined with all features; results of both sides."""
    return rounded(labels(spark, sf).select("symbol", "open_time_ms", "touch", "exit_offset", "target", *_L), 5, *_L)


#: A fixed linear score over four features, so that SQL can follow what a fitted one feeds.
WEIGHTS = {"momentum_3": 0.15, "ema_spread": 0.2, "bollinger_z": -0.1, "pressure": 0.3}
SCORE_SQL = "(" + " + ".join(f"{w} * {c}" for c, w in WEIGHTS.items()) + ")"
PROB_SQL = f"1 / (1 + exp(-greatest(-35.0, least(35.0, {SCORE_SQL}))))"


def score():
    return md.linear(tuple(WEIGHTS), 0.0, list(WEIGHTS.values()))


def scored(spark, sf):
    return labels(spark, sf).withColumns({"score": score(), "p": md.sigmoid(score())})


SCORED = LABEL + f", sc AS MATERIALIZED (SELECT *, {SCORE_SQL} AS score, {PROB_SQL} AS p FROM lab)"
_BIN = " + ".join(f"CAST(p >= {i / 10} AS INT)" for i in range(1, 10))


@query(f"""WITH RECURSIVE {SCORED}, r AS (SELECT symbol, avg(target) AS base FROM sc GROUP BY symbol), g AS (SELECT symbol, {_BIN} AS b, count(*) AS n, sum(p) AS sp, sum(target) AS sy, sum((p - target) ** 2) AS sq, sum((base - target) ** 2) AS sb, sum(CAST((p >= 0.5) = (target = 1) AS INT)) AS ok FROM sc JOIN r USING (symbol) GROUP BY ALL)
SELECT symbol, sum(n)::BIGINT AS n, round(sum(sq) / sum(n), 8) AS brier, round(sum(sb) / sum(n), 8) AS base_brier, round(sum(ok) / sum(n), 8) AS accuracy, round(sum(abs(sp - sy)) / sum(n), 8) AS ece FROM g GROUP BY symbol""")
def calibration_measures(spark, sf):
    """Brier scores, accuracy and expected calibration error by symbol."""
    return rounded(md.expected_calibration_error(scored(spark, sf), "p", "target", "symbol"), 8, "brier", "base_brier", "accuracy", "ece")


@query(f"WITH {CALM}, d AS (SELECT symbol, open_time_ms - {lag('open_time_ms', 1)} AS d FROM bars) SELECT symbol, greatest({DAY}, CAST(24 * quantile_cont(d, 0.5) AS BIGINT)) AS block_ms FROM d WHERE d > 0 GROUP BY symbol")
def block_lengths(spark, sf):
    return md.block_length(calm(spark, sf), 12, "symbol")


_Z6 = md.bonferroni_z(6)


def _low(z: float) -> str:
    return f"greatest(0, ((hits / signals) + {z * z} / (2 * signals)) / (1 + {z * z} / signals) - {z} * sqrt((hits / signals) * (1 - hits / signals) / signals + {z * z} / (4.0 * signals * signals)) / (1 + {z * z} / signals))"


@query(f"""WITH RECURSIVE {SCORED}, t AS (SELECT symbol, open_time_ms // {24 * DAY} AS block, CAST((p >= 0.5) = (target = 1) AS INT) AS correct, CASE WHEN p >= 0.5 THEN long_net ELSE short_net END AS net, touch FROM sc WHERE p >= 0.6 OR p <= 0.4),
g AS (SELECT symbol, count(*) AS signals, sum(correct)::BIGINT AS hits, avg(net) AS net_edge, count(DISTINCT block) AS blocks, avg(CAST(touch <> 'NONE' AS INT)) AS resolved, avg(CAST(touch = 'BOTH' AS INT)) AS ambiguous FROM t GROUP BY symbol), h AS (SELECT *, hits / signals AS accuracy, {_wilson('hits', 'signals', '-')} AS low, {_wilson('hits', 'signals', '+')} AS high, {_low(_Z6)} AS family_low FROM g),
r AS (SELECT *, list_filter([CASE WHEN signals < 100 THEN 'signals' END, CASE WHEN accuracy < 0.53 THEN 'accuracy' END, CASE WHEN family_low <= 0.5 THEN 'family' END, CASE WHEN net_edge <= 0 THEN 'edge' WHEN blocks < 12 THEN 'blocks' END], lambda x: x IS NOT NULL) AS rs FROM h)
SELECT symbol, signals, hits, round(net_edge, 5) AS net_edge, blocks, round(resolved, 8) AS resolved, round(ambiguous, 8) AS ambiguous, round(accuracy, 8) AS accuracy, round(low, 8) AS low, round(high, 8) AS high, round(family_low, 8) AS family_low, array_to_string(rs, ',') AS reasons, len(rs) = 0 AS passed FROM r""")
def research_gates(spark, sf):
    """Backtest measures of the confident rows by symbol, and the reasons against them."""
    r = scored(spark, sf).where("p >= 0.6 or p <= 0.4")
    up = F.col("p") >= 0.5
    t = r.select("symbol", F.floor(F.col("open_time_ms") / (24 * DAY)).alias("block"), (up == (F.col("target") == 1)).cast("int").alias("correct"), F.when(up, F.col("long_net")).otherwise(F.col("short_net")).alias("net"), "touch")
    return rounded(rounded(md.research_gate(t, "symbol"), 5, "net_edge"), 8, "resolved", "ambiguous", "accuracy", "low", "high", "family_low")


CUT = 900_000_000_000


@query(f"""WITH RECURSIVE {SCORED}, s AS (SELECT *, CASE WHEN open_time_ms + (exit_offset + 1) * {DAY} < {CUT} THEN 'train' WHEN open_time_ms < {CUT} THEN 'purged' ELSE 'test' END AS segment FROM sc) SELECT symbol, segment, count(*) AS n, round(avg(target), 8) AS rate FROM s GROUP BY ALL""")
def purged_split(spark, sf):
    """Rows before, across and after a cut by their exit."""
    r = labels(spark, sf).withColumn("exit_ms", F.col("open_time_ms") + (F.col("exit_offset") + 1) * F.lit(DAY).cast("long"))
    return rounded(md.purged(r, F.lit(CUT), "open_time_ms", "exit_ms").groupBy("symbol", "segment").agg(F.count("*").alias("n"), F.avg("target").alias("rate")), 8, "rate")


ROLES = SCORED + f""", rl0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM sc), rl AS (SELECT *, CASE WHEN i < floor(n * 0.9) THEN 'train' WHEN i >= floor(n * 0.9) + 12 THEN 'calibration' ELSE 'embargo' END AS role FROM rl0)"""


@query(f"WITH RECURSIVE {ROLES} SELECT symbol, role, count(*) AS n, count(*) FILTER (i % 12 = 0) AS disjoint, min(open_time_ms) AS first_ms FROM rl GROUP BY ALL")
def final_fit_roles(spark, sf):
    """Roles of the final fit, and how many of their rows have disjoint outcome windows."""
    r = md.final_split(labels(spark, sf), 12)
    one = md.every_nth(r, 12).groupBy("symbol", "role").agg(F.count("*").alias("disjoint"))
    g = r.groupBy("symbol", "role").agg(F.count("*").alias("n"), F.min("open_time_ms").alias("first_ms"))
    return g.join(one, ["symbol", "role"], "left").withColumn("disjoint", F.coalesce("disjoint", F.lit(0)))


@query(f"""WITH RECURSIVE {ROLES}, c AS (SELECT symbol, quantile_cont(score, 0.8) AS threshold FROM rl WHERE role = 'train' GROUP BY symbol) SELECT rl.symbol, open_time_ms, round(score, 8) AS score, round(threshold, 8) AS threshold FROM rl JOIN c USING (symbol) WHERE role = 'calibration' AND score >= threshold""")
def ranked_signals(spark, sf):
    """Later rows whose score reaches the 80 % quantile of the earlier ones, by symbol."""
    r = md.final_split(scored(spark, sf), 12).withColumn("role", F.when(F.col("role") == "train", "calibration").when(F.col("role") == "calibration", "test"))
    return rounded(md.scored_threshold(r, "score", "role", "symbol").select("symbol", "open_time_ms", "score", "threshold"), 8, "score", "threshold")


@query(f"""WITH RECURSIVE {SCORED}, m AS (SELECT avg(momentum_12) AS m, stddev_pop(momentum_12) AS s FROM sc WHERE symbol = 'A'), z AS (SELECT sc.*, greatest(-8, least(8, (momentum_12 - m) / CASE WHEN s < 1e-9 THEN 1 ELSE s END)) AS z FROM sc, m), t AS (SELECT quantile_cont(z, 0.8) AS cut FROM z WHERE symbol = 'A')
SELECT symbol, count(*) AS n, round(avg(target), 8) AS hit_rate, round(avg(long_net), 5) AS mean_net FROM z, t WHERE symbol <> 'A' AND open_time_ms >= {CUT} AND z >= cut GROUP BY symbol""")
def transfer_test(spark, sf):
    """Scale and threshold from one series, applied to the others after a fixed start."""
    r = labels(spark, sf)
    z = md.scaled(r, md.standard_scale(r, ("momentum_12",), F.col("symbol") == "A"))
    z = z.withColumn("role", F.when(F.col("symbol") == "A", "calibration").when(F.col("open_time_ms") >= CUT, "test")).withColumn("fold", F.lit(0))
    t = md.scored_threshold(z, "momentum_12", "role", "fold")
    return rounded(rounded(t.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("target").alias("hit_rate"), F.avg("long_net").alias("mean_net")), 8, "hit_rate"), 5, "mean_net")


@query(f"""WITH {LEDGER}, m AS (SELECT quantile_cont(spread_bps, 0.5) AS a, quantile_cont(net, 0.5) AS b FROM ledger WHERE bar_ms < {CUT}) SELECT id, coalesce(spread_bps, a) AS spread_bps, coalesce(net, b) AS net, CAST(spread_bps IS NULL AS INT) AS spread_bps_missing, CAST(net IS NULL AS INT) AS net_missing FROM ledger, m""")
def imputation(spark, sf):
    """Missing features filled with the training rows' medians and marked."""
    return md.imputed(signals(spark, sf).select("id", "bar_ms", "spread_bps", "net"), ("spread_bps", "net"), F.col("bar_ms") < CUT).drop("bar_ms")


@query(f"""WITH {LEDGER}, a AS (SELECT id, id % 100 / 100.0 AS p2, (id // 3) % 100 / 100.0 AS p3, (id // 7) % 100 / 100.0 AS p5 FROM ledger), b AS (SELECT id, p2, least(p3, p2) AS p3, least(p5, least(p3, p2)) AS p5 FROM a)
SELECT *, CASE WHEN p2 >= 0.4 AND p2 - p3 >= 0.1 THEN 'LONG' WHEN p3 >= 0.4 AND p3 - p2 >= 0.1 THEN 'SHORT' ELSE 'NONE' END AS side FROM b""")
def nested_probabilities(spark, sf):
    """Monotone probabilities over rising levels, and a side with a margin."""
    u = F.col("id")
    r = signals(spark, sf).select("id", (u % 100 / 100.0).alias("p2"), (F.floor(u / 3) % 100 / 100.0).alias("p3"), (F.floor(u / 7) % 100 / 100.0).alias("p5"))
    return r.withColumns(md.nested({2: "p2", 3: "p3", 5: "p5"})).withColumn("side", md.side_choice(F.col("p2"), F.col("p3"), 0.1, 0.4))


@query(f"""WITH {LEDGER}, t AS (SELECT strategy AS variant, bar_ms, settled_ms, net, bar_ms // {7 * DAY} AS week FROM ledger), x AS (SELECT *, unnest([week + 1, week + 2, week + 3, week + 4]) AS target FROM t), g AS (SELECT target, variant, count(*) AS n, count(DISTINCT bar_ms // {DAY}) AS days, avg(net) AS m FROM x WHERE settled_ms < target * {7 * DAY} GROUP BY ALL),
b AS (SELECT * FROM g WHERE n >= 20 AND days >= 10 AND m > 5 QUALIFY row_number() OVER (PARTITION BY target ORDER BY m DESC, variant) = 1) SELECT week, variant, n, round(m, 6) AS mean_net FROM (SELECT DISTINCT week FROM t) LEFT JOIN b ON target = week""")
def weekly_selector(spark, sf):
    """Each week's variant by the four weeks before."""
    t = signals(spark, sf).select(F.col("strategy").alias("variant"), F.col("bar_ms").alias("signal_ms"), F.col("settled_ms").alias("exit_ms"), "net")
    return rounded(md.weekly_selector(t, least=20, edge=5.0), 6, "mean_net")


@query(f"""WITH {LEDGER}, t AS (SELECT bar_ms // {DAY} AS day, settled_ms // {DAY} AS done, symbol IN ('C1', 'C2') AS held FROM ledger), d AS (SELECT day, count(*) AS scored, count(*) FILTER (held) AS held_out FROM t GROUP BY day), e AS (SELECT done AS day, count(*) AS new FROM t WHERE NOT held GROUP BY done)
SELECT day, coalesce((SELECT sum(new) FROM e WHERE e.day < d.day), 0)::BIGINT AS train, scored, held_out, coalesce((SELECT sum(new) FROM e WHERE e.day < d.day), 0) >= 500 AS fitted FROM d""")
def daily_refits(spark, sf):
    """Training and scored rows of an expanding daily refit with a held-out cohort."""
    t = signals(spark, sf).select("symbol", F.col("bar_ms").alias("signal_ms"), F.col("settled_ms").alias("exit_ms"))
    return md.daily_refits(t, 500, F.col("symbol").isin("C1", "C2"))


@query(f"""WITH {LEDGER}, i AS (SELECT * FROM ledger) SELECT i.id, count(l.net) AS n, count(*) FILTER (l.net > 0) AS wins, round(sum(l.net) / nullif(count(l.net), 0), 6) AS mean_net FROM i LEFT JOIN ledger l ON l.family = i.family AND l.regime = i.regime AND l.settled_ms < i.bar_ms GROUP BY i.id""")
def point_in_time(spark, sf):
    """What every signal could know of its family and regime when it came."""
    l = signals(spark, sf)
    return rounded(md.point_in_time(l, l, "family", "regime"), 6, "mean_net")


@query(f"""WITH {LEDGER}, r AS (SELECT level, CAST(gross >= level AS INT) AS hit, id % 97 / 96.0 AS p FROM ledger, (VALUES (50.0), (100.0), (200.0)) v(level)), b AS (SELECT *, avg(hit) OVER (PARTITION BY level) AS base FROM r)
SELECT CAST(level AS DOUBLE) AS level, count(*) AS n, sum(hit)::BIGINT AS hits, round(count(*) FILTER (p >= 0.5 AND hit = 1) / sum(hit), 8) AS recall, count(*) FILTER (p >= 0.5 AND hit = 0) AS false_alerts, count(*) FILTER (p < 0.5 AND hit = 1) AS missed, round(avg((p - hit) ** 2), 8) AS brier, round(avg((base - hit) ** 2), 8) AS base_brier FROM b GROUP BY level""")
def touch_lift(spark, sf):
    """Recall, false alerts, misses and Brier scores by level."""
    r = signals(spark, sf).select(F.col("gross").alias("move"), (F.col("id") % 97 / 96.0).alias("p"))
    return rounded(md.touch_lift(r, (50, 100, 200)), 8, "recall", "brier", "base_brier")


@query(f"""WITH RECURSIVE {SCORED}, n AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms DESC) = 1)
SELECT symbol, open_time_ms, round(p, 8) AS probability, CASE WHEN p >= 0.5 THEN 'UP' ELSE 'DOWN' END AS direction, round(greatest(p, 1 - p), 8) AS confidence, round(close * exp(-barrier_bps / 10000), 6) AS low_price, round(close * exp(barrier_bps / 10000), 6) AS high_price,
  (SELECT string_agg(k, ',' ORDER BY abs(v) DESC, k) FROM (VALUES {', '.join(f"('{c}', {w} * {c})" for c, w in WEIGHTS.items())}) x(k, v)) AS contributions FROM n""")
def latest_scores(spark, sf):
    """The newest row of each series: probability, direction, confidence, price range and contributions by size."""
    newest = scored(spark, sf).groupBy("symbol").agg(F.max_by(F.struct("open_time_ms", "close", "p", "barrier_bps", *WEIGHTS), "open_time_ms").alias("r")).select("symbol", "r.*")
    parts = F.array(*[F.struct((-F.abs(F.col(c) * w)).alias("v"), F.lit(c).alias("k")) for c, w in WEIGHTS.items()])
    move = F.col("barrier_bps") / 10_000
    return newest.select("symbol", "open_time_ms", F.round("p", 8).alias("probability"), F.when(F.col("p") >= 0.5, "UP").otherwise("DOWN").alias("direction"), F.round(F.greatest(F.col("p"), 1 - F.col("p")), 8).alias("confidence"), F.round(F.col("close") * F.exp(-move), 6).alias("low_price"),
                         F.round(F.col("close") * F.exp(move), 6).alias("high_price"), F.array_join(F.transform(F.array_sort(parts), lambda x: x.k), ",").alias("contributions"))


@query()
def logistic_scores(spark, sf):
    """A logistic model fitted by Spark ML on each series' first nine tenths, calibrated on its tail after an embargo, applied to all
    rows. Coefficients have no SQL form; the tests hold them against Newton's method."""
    bars = fs.kept(calm(spark, sf), "logistic-bars")  # the trades are read once
    rows = fs.kept(md.final_split(mk.supervised(bars, floor_bps=50.0), 12).select("symbol", "open_time_ms", "role", "target", *mk.FEATURES), "logistic-rows")
    train = F.col("role") == "train"
    z = md.scaled(rows, md.standard_scale(rows, mk.FEATURES, train)).cache()
    intercept, weights = md.fit_logistic(z.where(train), mk.FEATURES, "target", 1.0)
    z = z.withColumn("logit", md.linear(mk.FEATURES, intercept, weights))
    slope, base = md.fit_platt(z.where("role = 'calibration'"), "logit", "target")
    assert math.isfinite(slope + base)
    return z.select("symbol", "open_time_ms", "role", "target", "logit", md.sigmoid(F.col("logit") * slope + base).alias("probability"))


#: Horizons in rows, and the two features whose fits SQL repeats by Newton steps in a recursion.
HORIZONS, PAIR = (3, 12, 48), ("momentum_3", "bollinger_z")
_KEY = "symbol, horizon, fit"


def _clip(x: str, bound: float) -> str:
    return f"greatest(-{bound}, least({bound}, {x}))"


def _sig(x: str) -> str:
    return f"1 / (1 + exp(-{_clip(x, 35.0)}))"


def _base(x: str) -> str:
    return f"ln(greatest(1e-4, least(1 - 1e-4, {x})) / (1 - greatest(1e-4, least(1 - 1e-4, {x}))))"


def newton2_sql(name: str, rows: str, key: str, l2: float, where: str = "TRUE", steps: int = 24) -> str:
    """``name``: key, a, b, c: intercept and two weights of the rows' (x, z, y) fit, three by three by Cramer's rule, no step longer than one."""
    det = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
    return f"""{name}_r AS MATERIALIZED (SELECT {key}, x, z, y FROM {rows} WHERE {where}),
{name}_n AS (SELECT {key}, 0 AS k, {_base('avg(y)')} AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM {name}_r GROUP BY {key}
  UNION ALL SELECT {key}, k + 1, a - d0 / greatest(1, abs(d0), abs(d1), abs(d2)), b - d1 / greatest(1, abs(d0), abs(d1), abs(d2)), c - d2 / greatest(1, abs(d0), abs(d1), abs(d2)) FROM (
  SELECT *, (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / {det} AS d0, (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / {det} AS d1,
    (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / {det} AS d2 FROM (
    SELECT {key}, k, a, b, c, sum(p - y) AS g0, sum(x * (p - y)) + {l2} * b AS g1, sum(z * (p - y)) + {l2} * c AS g2, sum(w) AS h00, sum(w * x) AS h01, sum(w * z) AS h02, sum(w * x * x) + {l2} AS h11, sum(w * x * z) AS h12, sum(w * z * z) + {l2} AS h22 FROM (
      SELECT *, greatest(p * (1 - p), 1e-6) AS w FROM (SELECT n.*, x, z, y, {_sig('a + b * x + c * z')} AS p FROM {name}_n n JOIN {name}_r USING ({key}) WHERE k < {steps})) GROUP BY {key}, k, a, b, c))),
{name} AS MATERIALIZED (SELECT {key}, a, b, c FROM {name}_n WHERE k = {steps})"""


def platt_sql(name: str, rows: str, key: str, where: str = "TRUE", steps: int = 24) -> str:
    """``name``: key, slope, base of the rows' (logit, y)."""
    return f"""{name}_r AS MATERIALIZED (SELECT {key}, logit AS x, y FROM {rows} WHERE {where}),
{name}_g AS (SELECT {key}, {_base('avg(y)')} AS flat, min(y) = max(y) OR stddev_pop(x) < 1e-9 AS one FROM {name}_r GROUP BY {key}),
{name}_n AS (SELECT {key}, 0 AS k, flat AS a, 0.0::DOUBLE AS b FROM {name}_g
  UNION ALL SELECT {key}, k + 1, a - d0 / greatest(1, abs(d0), abs(d1)), b - d1 / greatest(1, abs(d0), abs(d1)) FROM (SELECT *, (g0 * h11 - h01 * g1) / (h00 * h11 - h01 * h01) AS d0, (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS d1 FROM (
    SELECT {key}, k, a, b, sum(p - y) AS g0, sum(x * (p - y)) + 0.01 * b AS g1, sum(w) AS h00, sum(w * x) AS h01, sum(w * x * x) + 0.01 AS h11 FROM (
      SELECT *, greatest(p * (1 - p), 1e-6) AS w FROM (SELECT n.*, x, y, {_sig('a + b * x')} AS p FROM {name}_n n JOIN {name}_r USING ({key}) WHERE k < {steps})) GROUP BY {key}, k, a, b))),
{name} AS MATERIALIZED (SELECT {key}, CASE WHEN one OR b < 0 THEN 0 ELSE b END AS slope, CASE WHEN one OR b < 0 THEN flat ELSE a END AS base FROM {name}_n JOIN {name}_g USING ({key}) WHERE k = {steps})"""


def _scale_sql(x: str, i: str) -> str:
    return _clip(f"({x} - m{i}) / CASE WHEN d{i} < 1e-9 THEN 1 ELSE d{i} END", 8.0)


SERIES_MODELS = FEAT + ",\n" + ",\n".join(label_sql(h, f"lab{h}", more=f", {h} AS horizon") for h in HORIZONS) + f""",
lx AS ({' UNION ALL '.join(f'SELECT * FROM lab{h}' for h in HORIZONS)}),
r0 AS (SELECT *, row_number() OVER (PARTITION BY symbol, horizon ORDER BY open_time_ms) - 1 AS i, count(*) OVER (PARTITION BY symbol, horizon) AS n FROM lx),
r1 AS (SELECT *, n - size AS test, n - 2 * size - horizon AS cal FROM (SELECT *, greatest(120, floor(n * 0.15))::BIGINT AS size FROM r0)),
r2 AS (SELECT *, 'test' AS fit, CASE WHEN i < cal - horizon THEN 'train' WHEN i >= cal AND i < test - horizon THEN 'calibration' WHEN i >= test THEN 'test' END AS role FROM r1 WHERE cal - horizon >= 500 AND test < n
  UNION ALL SELECT *, 'live', CASE WHEN i < test - horizon THEN 'train' WHEN i >= test THEN 'calibration' END FROM r1 WHERE cal - horizon >= 500 AND test < n),
sc AS (SELECT {_KEY}, {', '.join(f'avg({c}) AS m{i}, stddev_pop({c}) AS d{i}' for i, c in enumerate(PAIR))} FROM r2 WHERE role = 'train' GROUP BY {_KEY}),
z AS MATERIALIZED (SELECT {_KEY}, role, role = 'test' AND (i - test) % horizon = 0 AS disjoint, target AS y, long_net, short_net, {_scale_sql(PAIR[0], '0')} AS x, {_scale_sql(PAIR[1], '1')} AS z FROM r2 JOIN sc USING ({_KEY}) WHERE role IS NOT NULL),
{newton2_sql('mo', 'z', _KEY, 1.0, "role = 'train'")},
lo AS MATERIALIZED (SELECT z.*, a + b * x + c * z.z AS logit FROM z JOIN mo USING ({_KEY}) WHERE role <> 'train'),
{platt_sql('pl', 'lo', _KEY, "role = 'calibration'")},
te AS (SELECT symbol, horizon, disjoint, y, long_net, short_net, {_sig('slope * logit + base')} AS p, avg(y) OVER (PARTITION BY symbol, horizon) AS rate FROM lo JOIN pl USING ({_KEY}) WHERE role = 'test'),
ju AS (SELECT symbol, horizon, count(*) AS test_count, count(*) FILTER ((p >= 0.5) = (y = 1)) AS hits, avg((p - y) ** 2) AS brier, avg((rate - y) ** 2) AS base_brier, avg(CASE WHEN p >= 0.5 THEN long_net ELSE short_net END) AS mean_net FROM te WHERE disjoint GROUP BY ALL),
nw AS (SELECT * FROM feat WHERE {' AND '.join(f'{c} IS NOT NULL' for c in mk.FEATURES)} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms DESC) = 1),
li AS (SELECT symbol, horizon, {_sig(f"slope * (a + b * {_scale_sql(PAIR[0], '0')} + c * {_scale_sql(PAIR[1], '1')}) + base")} AS probability_up FROM nw JOIN sc USING (symbol) JOIN mo USING ({_KEY}) JOIN pl USING ({_KEY}) WHERE fit = 'live'),
tr AS (SELECT symbol, horizon, count(*) AS live_train FROM z WHERE fit = 'live' AND role = 'train' GROUP BY ALL)
SELECT symbol, horizon, test_count, round(hits / test_count, 8) AS accuracy, round({_wilson('hits', 'test_count', '-')}, 8) AS low, round({_wilson('hits', 'test_count', '+')}, 8) AS high, round(brier, 6) AS brier, round(base_brier, 6) AS base_brier, round(mean_net, 4) AS mean_net, round(probability_up, 6) AS probability_up, live_train
FROM ju JOIN li USING (symbol, horizon) JOIN tr USING (symbol, horizon)"""


def horizon_labels(spark, sf):
    """Labels of every horizon, and the newest row with all features by series and horizon."""
    bars = calm(spark, sf)
    rows = None
    for h in HORIZONS:
        r = mk.supervised(bars, h, floor_bps=50.0).withColumn("horizon", F.lit(h))
        rows = r if rows is None else rows.unionByName(r)
    newest = mk.feature_frame(bars).dropna(subset=list(mk.FEATURES)).groupBy("symbol").agg(F.max_by(F.struct(*mk.FEATURES), "open_time_ms").alias("r")).select("symbol", "r.*")
    return rows, newest.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in HORIZONS])))


@query(f"WITH RECURSIVE {SERIES_MODELS}")
def series_models(spark, sf):
    """A calibrated model for each series and horizon, judged on disjoint later windows, with the newest row's probability."""
    rows, newest = horizon_labels(spark, sf)
    r = ft.series_models(rows, newest, ("symbol", "horizon"), PAIR).drop("intercept", "weights", "slope", "offset")
    return rounded(rounded(rounded(r, 8, "accuracy", "low", "high"), 6, "brier", "base_brier", "probability_up"), 4, "mean_net")


_BEFORE = "r.day {} d.day"
REFITS = LEDGER + f""",
rr AS MATERIALIZED (SELECT id, bar_ms // {DAY} AS day, symbol IN ('C1', 'C2') AS held, CASE WHEN net IS NULL THEN NULL ELSE CAST(net > 0 AS INT) END AS y, score AS f0, volatility_bps / 100 AS f1 FROM ledger),
dd AS (SELECT DISTINCT day FROM rr), ok AS MATERIALIZED (SELECT * FROM rr WHERE NOT held AND y IS NOT NULL),
dy AS (SELECT day, count(*) AS n, sum(y) AS h, sum(f0) AS s0, sum(f0 * f0) AS q0, sum(f1) AS s1, sum(f1 * f1) AS q1 FROM ok GROUP BY day),
fo AS MATERIALIZED (SELECT d.day, coalesce(sum(n) FILTER (r.day <= d.day - 8), 0)::BIGINT AS train, coalesce(sum(h) FILTER (r.day <= d.day - 8), 0) AS hits, coalesce(sum(n) FILTER (r.day BETWEEN d.day - 6 AND d.day - 2), 0)::BIGINT AS calibration, coalesce(sum(h) FILTER (r.day BETWEEN d.day - 6 AND d.day - 2), 0) AS cal_hits,
  {', '.join(f'sum(s{i}) FILTER (r.day <= d.day - 8) AS s{i}, sum(q{i}) FILTER (r.day <= d.day - 8) AS q{i}' for i in (0, 1))} FROM dd d LEFT JOIN dy r ON r.day < d.day GROUP BY d.day),
fs AS MATERIALIZED (SELECT *, CASE WHEN train < 150 OR calibration < 10 THEN 'insufficient_history' WHEN least(hits, train - hits) < 10 OR least(cal_hits, calibration - cal_hits) < 3 THEN 'insufficient_classes' ELSE 'fitted' END AS st, {', '.join(f's{i} / train AS m{i}, sqrt(greatest(q{i} / train - (s{i} / train) ** 2, 0)) AS d{i}' for i in (0, 1))} FROM fo),
zz AS MATERIALIZED (SELECT f.day AS fold, o.day, o.y, {_scale_sql('f0', '0')} AS x, {_scale_sql('f1', '1')} AS z FROM fs f JOIN ok o ON o.day <= f.day - 2 WHERE st = 'fitted' AND (o.day <= f.day - 8 OR o.day >= f.day - 6)),
{newton2_sql('mo', 'zz', 'fold', 10.0, 'day <= fold - 8', 7)},
lo AS (SELECT fold, y, a + b * x + c * zz.z AS logit FROM zz JOIN mo USING (fold) WHERE day >= fold - 6),
{platt_sql('pl', 'lo', 'fold')}
SELECT rr.id, rr.day, train, calibration, CASE WHEN st <> 'fitted' THEN st WHEN slope > 0 THEN 'calibrated' ELSE 'calibration_failed' END AS status, round((cal_hits + 1) / (calibration + 2), 8) AS base_rate,
  round(CASE WHEN st = 'fitted' THEN {_sig(f"slope * (a + b * {_scale_sql('f0', '0')} + c * {_scale_sql('f1', '1')}) + base")} WHEN st = 'insufficient_classes' THEN (cal_hits + 1) / (calibration + 2) END, 6) AS probability
FROM rr JOIN fs USING (day) LEFT JOIN mo ON mo.fold = rr.day LEFT JOIN pl ON pl.fold = rr.day"""


@query(f"WITH RECURSIVE {REFITS}")
def refit_scores(spark, sf):
    """Every signal's probability from the model of its day: fitted on all days before, calibrated on five, a cohort held out."""
    l = signals(spark, sf)
    rows = l.select("id", F.col("bar_ms").alias("t"), F.col("symbol").isin("C1", "C2").alias("held"), (F.col("net") > 0).cast("int").alias("target"), F.col("score").alias("f0"), (F.col("volatility_bps") / 100).alias("f1"))
    return rounded(rounded(ft.expanding_refits(rows, ("f0", "f1"), least_calibration=10, least_class=(10, 3)), 8, "base_rate"), 6, "probability")


#: Five yearly folds of the ledger: all settled before, half a year to calibrate, a year to test.
FOLDS = [757_382_400_000 + k * 365 * DAY for k in range(5)]
HALF = 180 * DAY


def ranked_sql(rows: str, key: str, f0: str, f1: str, keep: str) -> str:
    """The ranker on ``rows`` (key, role, f0, f1, y and ``keep``) as the tables md, sr, zr, mr, sr2, th."""
    return f"""md AS (SELECT {key}, quantile_cont({f0}, 0.5) AS q0, quantile_cont({f1}, 0.5) AS q1 FROM {rows} WHERE role = 'train' GROUP BY {key}),
fl AS MATERIALIZED (SELECT {key}, role, y, {keep}, coalesce({f0}, q0, 0.0) AS f0, coalesce({f1}, q1, 0.0) AS f1 FROM {rows} JOIN md USING ({key})),
sr AS (SELECT {key}, avg(f0) AS m0, stddev_pop(f0) AS d0, avg(f1) AS m1, stddev_pop(f1) AS d1 FROM fl WHERE role = 'train' GROUP BY {key}),
zr AS MATERIALIZED (SELECT {key}, role, y, {keep}, {_scale_sql('f0', '0')} AS x, {_scale_sql('f1', '1')} AS z FROM fl JOIN sr USING ({key})),
{newton2_sql('mr', 'zr', key, 10.0, "role = 'train' AND y IS NOT NULL")},
sc2 AS MATERIALIZED (SELECT {key}, role, {keep}, a + b * x + c * zr.z AS score FROM zr JOIN mr USING ({key}) WHERE role <> 'train'),
th AS (SELECT {key}, quantile_cont(score, 0.8) AS threshold FROM sc2 WHERE role = 'calibration' GROUP BY {key})"""


@query(f"""WITH RECURSIVE {LEDGER}, fo(fold, cut) AS (VALUES {', '.join(f'({k}, {c})' for k, c in enumerate(FOLDS))}),
rk AS MATERIALIZED (SELECT * FROM (SELECT fold, id, symbol, bar_ms, CASE WHEN settled_ms < cut - {HALF} THEN 'train' WHEN bar_ms >= cut - {HALF} AND settled_ms < cut THEN 'calibration' WHEN bar_ms >= cut AND bar_ms < cut + {365 * DAY} THEN 'test' END AS role, score AS s, spread_bps AS p, CAST(gross > 30 AS INT) AS y FROM ledger, fo) WHERE role IS NOT NULL),
{ranked_sql('rk', 'fold', 's', 'p', 'id')} SELECT fold, id, round(score, 6) AS score, round(threshold, 6) AS threshold FROM sc2 JOIN th USING (fold) WHERE role = 'test' AND score >= threshold""")
def fitted_ranker(spark, sf):
    """Signals of five yearly folds whose fitted score reaches the 80 % quantile of the half year before."""
    l = signals(spark, sf).withColumn("f", F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(c).alias("cut")) for k, c in enumerate(FOLDS)])))
    cut, bar, out = F.col("f.cut"), F.col("bar_ms"), F.col("settled_ms")
    role = F.when(out < cut - HALF, "train").when((bar >= cut - HALF) & (out < cut), "calibration").when((bar >= cut) & (bar < cut + 365 * DAY), "test")
    rows = l.select(F.col("f.fold").alias("fold"), "id", role.alias("role"), F.col("score").alias("f0"), F.col("spread_bps").alias("f1"), (F.col("gross") > 30).cast("int").alias("y")).where("role is not null")
    return rounded(ft.ranked(rows, ("fold",), ("f0", "f1"), "y").where("selected").select("fold", "id", "score", "threshold"), 6, "score", "threshold")


@query(f"""WITH RECURSIVE {LABEL}, tf AS MATERIALIZED (SELECT * FROM (SELECT 0 AS fold, symbol, open_time_ms, long_net, target AS y, CASE WHEN symbol = 'A' THEN CASE WHEN open_time_ms < 850000000000 THEN 'train' WHEN open_time_ms >= {850_000_000_000 + 12 * DAY} THEN 'calibration' END WHEN open_time_ms >= {CUT} THEN 'test' END AS role, {', '.join(PAIR)} FROM lab) WHERE role IS NOT NULL),
{ranked_sql('tf', 'fold', *PAIR, 'symbol, open_time_ms, long_net')} SELECT symbol, open_time_ms, round(score, 6) AS score, round(threshold, 6) AS threshold, score >= threshold AS selected, round(long_net, 5) AS long_net FROM sc2 JOIN th USING (fold) WHERE role = 'test'""")
def fitted_transfer(spark, sf):
    """A model trained and calibrated on one series, with its fixed threshold, on the rows of the others after a fixed start."""
    t = F.col("open_time_ms")
    role = F.when(F.col("symbol") == "A", F.when(t < 850_000_000_000, "train").when(t >= 850_000_000_000 + 12 * DAY, "calibration")).when(t >= CUT, "test")
    rows = labels(spark, sf).select(F.lit(0).alias("fold"), "symbol", "open_time_ms", "long_net", "target", role.alias("role"), *PAIR).where("role is not null")
    out = ft.ranked(rows, ("fold",), PAIR, "target").select("symbol", "open_time_ms", "score", "threshold", "selected", "long_net")
    return rounded(rounded(out, 6, "score", "threshold"), 5, "long_net")


BUNDLES = LABEL + f""",
rb AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM lab),
ro AS MATERIALIZED (SELECT *, CASE WHEN i < floor(n * 0.9) THEN 'train' WHEN i >= floor(n * 0.9) + 12 THEN 'calibration' END AS role FROM rb),
sb AS (SELECT symbol, {', '.join(f'avg({c}) AS m{i}, stddev_pop({c}) AS d{i}' for i, c in enumerate(PAIR))} FROM ro WHERE role = 'train' GROUP BY symbol),
zb AS MATERIALIZED (SELECT symbol, role, target AS y, {_scale_sql(PAIR[0], '0')} AS x, {_scale_sql(PAIR[1], '1')} AS z FROM ro JOIN sb USING (symbol) WHERE role IS NOT NULL),
{newton2_sql('mb', 'zb', 'symbol', 1.0, "role = 'train'")},
lb AS (SELECT symbol, y, a + b * x + c * zb.z AS logit FROM zb JOIN mb USING (symbol) WHERE role = 'calibration'),
{platt_sql('pb', 'lb', 'symbol')},
nb AS (SELECT *, {_scale_sql(PAIR[0], '0')} * b * slope AS c0, {_scale_sql(PAIR[1], '1')} * c * slope AS c1, a * slope + base AS c2 FROM (SELECT * FROM lab QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms DESC) = 1) JOIN sb USING (symbol) JOIN mb USING (symbol) JOIN pb USING (symbol)),
qb AS (SELECT *, {_sig('c0 + c1 + c2')} AS p FROM nb WHERE symbol <> 'N')"""


@query(f"""WITH RECURSIVE {BUNDLES} SELECT symbol, round(p, 6) AS probability, CASE WHEN p >= 0.5 THEN 'UP' ELSE 'DOWN' END AS direction, round(greatest(p, 1 - p), 6) AS confidence, round(close * exp(-barrier_bps / 10000), 6) AS low_price, round(close * exp(barrier_bps / 10000), 6) AS high_price,
  CASE WHEN abs(c0) > abs(c1) OR abs(c0) = abs(c1) AND '{PAIR[0]}' < '{PAIR[1]}' THEN '{PAIR[0]},{PAIR[1]}' ELSE '{PAIR[1]},{PAIR[0]}' END AS contributions FROM qb""")
def bundle_scores(spark, sf):
    """Models fitted by series, saved as JSON, read back and applied to the newest rows; one has been damaged on the way and scores nothing."""
    rows = md.final_split(labels(spark, sf), 12).select("symbol", "open_time_ms", "close", "barrier_bps", "role", "target", *PAIR)
    rows = fs.kept(rows, "bundle-rows")
    keys, train = ("symbol",), F.col("role") == "train"
    table = ft.scales(rows.where(train), keys, PAIR)
    z = fs.kept(ft.with_scales(rows.where("role <> 'embargo'"), table, keys, PAIR), "bundle-rows")
    fit = ft.logistic_fits(z.where(train), keys, PAIR, "target")
    platt = ft.platt_fits(z.where(~train).join(fit, "symbol").withColumn("logit", ft.dot(PAIR)), keys, "logit", "target")
    made = ft.bundles(fit, table, platt, keys, PAIR, 2, F.lit(CUT)).withColumn("weights", F.when(F.col("symbol") == "N", F.array(F.lit(float("nan")), F.lit(1.0))).otherwise(F.col("weights")))
    path = fs.scratch(spark, "bundles")
    made.write.json(path)
    saved = spark.read.schema(made.schema).json(path)
    newest = rows.groupBy("symbol").agg(F.max_by(F.struct("close", "barrier_bps", *PAIR), "open_time_ms").alias("r")).select("symbol", "r.*")
    return rounded(ft.bundle_scores(newest, saved, keys, PAIR, 2), 6, "probability", "confidence", "low_price", "high_price")


@query(f"""WITH {LEDGER}, r AS (SELECT level, CASE WHEN id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side, id % 97 / 96.0 >= 0.7 AS selected, id % 97 / 96.0 AS p, id % 7 / 10.0 AS base_p, CASE WHEN status IS NOT NULL THEN CAST(gross >= level AS INT) END AS hl, CASE WHEN status IS NOT NULL THEN CAST(-gross >= level AS INT) END AS hs FROM ledger, (VALUES (50.0), (100.0), (200.0)) v(level)),
x AS (SELECT *, CASE WHEN side = 'LONG' THEN hl ELSE hs END AS hit FROM r WHERE hl IS NOT NULL),
g AS (SELECT CAST(level AS DOUBLE) AS level, count(*) AS n, sum(hit)::BIGINT AS hits, count(*) FILTER (selected) AS selected, count(*) FILTER (selected AND hit = 1) AS selected_hits, count(*) FILTER (selected AND hit = 0) AS false_alerts, count(*) FILTER (NOT selected AND hit = 1) AS missed, avg(hl) AS al, avg(hs) AS sh, avg((p - hit) ** 2) AS br, avg((base_p - hit) ** 2) AS bb FROM x GROUP BY 1)
SELECT level, n, hits, selected, selected_hits, false_alerts, missed, round(al, 8) AS always_long, round(sh, 8) AS always_short, round(br, 8) AS brier, round(bb, 8) AS base_brier, round(selected_hits / hits, 8) AS recall, round({_wilson('selected_hits', 'selected', '-')}, 8) AS low, round({_wilson('selected_hits', 'selected', '+')}, 8) AS high FROM g""")
def side_lift(spark, sf):
    """A directional score by level against always long, always short and its base rate."""
    i = F.col("id")
    l = signals(spark, sf).withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in (50, 100, 200)])))
    hit = lambda x: F.when(F.col("status").isNotNull(), (x >= F.col("level")).cast("int"))
    r = l.select("level", F.when(i % 2 == 0, "LONG").otherwise("SHORT").alias("side"), (i % 97 / 96.0 >= 0.7).alias("selected"), (i % 97 / 96.0).alias("p"), (i % 7 / 10.0).alias("base_p"), hit(F.col("gross")).alias("hit_long"), hit(-F.col("gross")).alias("hit_short"))
    return rounded(md.side_lift(r), 8, "always_long", "always_short", "brier", "base_brier", "recall", "low", "high")
