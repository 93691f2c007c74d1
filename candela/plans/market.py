"""Registered indicator, rule and regime queries with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import market as mk
from candela.plans.catalog import BARS_1D, DAY, query, rounded
from candela.sources import bars as src

CALM = BARS_1D.replace("bars AS (", "bars0 AS (") + ", bars AS (SELECT * REPLACE (" + ", ".join(f"1000.0 + {c} / 1000.0 AS {c}" for c in src.PRICES) + ") FROM bars0)"


def calm(spark, sf):
    return src.calm(src.bars_1d(spark, sf))


P = "PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN"


def _full(agg: str, x: str, a: int, b: int = 0, least: int | None = None) -> str:
    """A window aggregate over rows a back to b back, null with fewer than ``least`` values (all by default)."""
    over = f"OVER ({P} {a} PRECEDING AND {f'{b} PRECEDING' if b else 'CURRENT ROW'})"
    return f"CASE WHEN count({x}) {over} >= {least or a - b + 1} THEN {agg.format(x=x)} {over} END"


def _ewm(name: str, source: str, cols: dict[str, tuple[str, str]]) -> str:
    """One recursion for several exponentially weighted means; each starts at its first value."""
    first, then = ", ".join(f"{x} AS {c}" for c, (x, _) in cols.items()), ", ".join(f"CASE WHEN e.{c} IS NULL THEN o.{c} ELSE {a} * o.{c} + (1 - {a}) * e.{c} END" for c, (_, a) in cols.items())
    return f"""{name}_o AS (SELECT symbol, open_time_ms, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) AS rn, {first} FROM {source}),
{name} AS (SELECT * FROM {name}_o WHERE rn = 1 UNION ALL SELECT o.symbol, o.open_time_ms, o.rn, {then} FROM {name} e JOIN {name}_o o ON o.symbol = e.symbol AND o.rn = e.rn + 1)"""


_LAG = "lag({}, {}) OVER (PARTITION BY symbol ORDER BY open_time_ms)"
lag = _LAG.format
EMA = {f"e{n}": ("close", f"(2.0 / {n + 1})") for n in mk.EMAS}
IND = CALM + f""",
i0 AS (SELECT *, greatest(high - low, abs(high - {lag('close', 1)}), abs(low - {lag('close', 1)})) AS tr, greatest(close - {lag('close', 1)}, 0) AS gain, greatest({lag('close', 1)} - close, 0) AS loss, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) AS rn,
  ln(1 + volume) AS lv FROM bars),
i1 AS (SELECT * EXCLUDE (gain, loss), CASE WHEN {lag('close', 1)} IS NOT NULL THEN gain END AS gain, CASE WHEN {lag('close', 1)} IS NOT NULL THEN loss END AS loss FROM i0),
{_ewm('em', 'i1', {**EMA, 'atr': ('tr', '(1.0 / 14)'), 'eg': ('gain', '(1.0 / 14)'), 'el': ('loss', '(1.0 / 14)')})},
i2 AS (SELECT i1.*, {', '.join(f'CASE WHEN i1.rn >= {least} THEN e{n} END AS ema{n}' for n, least in mk.EMAS.items())}, CASE WHEN i1.rn >= 14 THEN em.atr END AS atr,
  CASE WHEN i1.rn >= 15 THEN CASE WHEN eg = 0 THEN 0 WHEN el = 0 THEN 100 ELSE 100 - 100 / (1 + eg / el) END END AS rsi FROM i1 JOIN em USING (symbol, open_time_ms)),
i3 AS (SELECT *, {lag('close', 1)} AS pc, {lag('open', 1)} AS po, {lag('high', 1)} AS ph, {lag('low', 1)} AS pl, {lag('volume', 1)} AS pv, {lag('ema20', 1)} AS pema20, {lag('rsi', 1)} AS prsi,
  {', '.join(f"{lag('ema50', k)} AS ema50_{k}" for k in mk.EMA_LAGS)}, {', '.join(f"close / {lag('close', k)} - 1 AS ret{k}" for k in mk.RETURNS)},
  ln(close) - ln({lag('close', 1)}) AS lr, ln(close / {lag('close', 6)}) AS r6, ln(close / {lag('close', 288)}) AS r288,
  {_full('avg({x})', 'close', 19)} AS mean20, {_full('stddev_pop({x})', 'close', 19)} AS sd20, {_full('avg({x})', 'tr', 13)} AS tr14,
  {', '.join(f"{_full('max({x})', 'high', n, 1)} AS hi{n}" for n in mk.HIGHS)}, {', '.join(f"{_full('min({x})', 'low', n, 1)} AS lo{n}" for n in mk.LOWS)},
  {_full('avg({x})', 'volume', 20, 1)} AS vmean20, {_full('sum({x})', 'quote_volume', 287)} AS quote288, {_full('quantile_cont({x}, 0.5)', 'quote_volume', 24, 1, 18)} AS qmed24,
  taker_buy_base / nullif(volume, 0) AS taker_ratio FROM i2),
i4 AS (SELECT *, {_full('stddev_samp({x})', 'lr', 287, 0, 144)} AS sigma, (lv - {_full('avg({x})', 'lv', 287, 0, 144)}) / nullif({_full('stddev_samp({x})', 'lv', 287, 0, 144)}, 0) AS vz, quote_volume / nullif(qmed24, 0) AS vol_ratio,
  mean20 - 2 * sd20 AS bb_low, mean20 + 2 * sd20 AS bb_high, {lag('hi12', 1)} AS phi12, {lag('hi48', 1)} AS phi48 FROM i3),
i5 AS (SELECT *, coalesce(bb_high < ema20 + 1.5 * atr AND bb_low > ema20 - 1.5 * atr, FALSE) AS squeeze, coalesce(bb_high < ema20 + 1.5 * tr14 AND bb_low > ema20 - 1.5 * tr14, FALSE) AS squeeze14, sigma * sqrt(6.0) AS sigma30, {lag('r6', 1)} AS pr6, {lag('r288', 1)} AS pr288 FROM i4),
ind AS MATERIALIZED (SELECT *, coalesce({lag('squeeze', 1)}, FALSE) AS psqueeze, {lag('sigma30', 1)} AS psigma30, coalesce(max(CAST(squeeze14 AS INT)) OVER ({P} 6 PRECEDING AND 1 PRECEDING), 0) > 0 AS recent_squeeze FROM i5)"""
BENCH = IND + f""",
bench AS (SELECT open_time_ms, close AS b_close, ema50 AS b_ema50, ema200 AS b_ema200, ret24 AS b_ret24, {', '.join(f"coalesce(close {o} ema50 AND ema50 {o} ema200 AND ema50 {o} ema50_{k}, FALSE) AS b_{n}{k}" for n, o in (('bull', '>'), ('bear', '<')) for k in (6, 12))} FROM ind WHERE symbol = 'A'),
w0 AS (SELECT ind.*, bench.* EXCLUDE (open_time_ms) FROM ind LEFT JOIN bench USING (open_time_ms)),
share AS (SELECT open_time_ms, count(*) FILTER (ema200 IS NOT NULL AND ret24 IS NOT NULL) AS eligible, count(*) FILTER (ema200 IS NOT NULL AND ret24 IS NOT NULL AND close > ema50 AND ema20 > ema50 AND ret24 > 0) AS risers, avg(CASE WHEN ema50 > ema200 THEN 1.0 ELSE 0 END) AS above FROM ind GROUP BY ALL),
wide AS MATERIALIZED (SELECT w0.*, eligible, above, risers / nullif(eligible, 0) AS breadth, b_close > b_ema50 AND b_ema50 > b_ema200 AND b_ema50 > {lag('b_ema50', 4)} AS b_bull4, b_close < b_ema50 AND b_ema50 < b_ema200 AND b_ema50 < {lag('b_ema50', 4)} AS b_bear4,
  {', '.join(f"ret{k} - (b_close / {lag('b_close', k)} - 1) AS rs{k}" for k in (4, 12, 16))}, min(low) OVER ({P} 4 PRECEDING AND 1 PRECEDING) AS low4,
  {_full('max({x})', 'high', 13, 2)} AS fall_high, {_full('min({x})', 'low', 13, 2)} AS fall_low, {_full('quantile_cont({x}, 0.5)', 'volume', 21, 2)} AS fall_volume FROM w0 JOIN share USING (open_time_ms))"""
#: The studies' thresholds fitted to these tables' candles.
STUDY = {"flow": 1.1, "taker": 0.5, "lead": 0.03, "least_markets": 3, "share": 0.3, "liquid": 1_000_000}
LIVE = {"z1": 1.0, "z2": 0.5, "shock": 1.0}
RULES = mk.study_rules(**STUDY)
REGIME = IND + f""",
br AS (SELECT open_time_ms, avg(CASE WHEN close > ema576 THEN 1.0 ELSE 0 END) AS breadth, count(*) AS votes FROM ind WHERE ema576 IS NOT NULL GROUP BY ALL),
mj0 AS (SELECT *, {lag('ema1200', 168)} AS old, ln(close / {lag('close', 672)}) AS now4, ln({lag('close', 168)} / {lag('close', 840)}) AS then4 FROM ind WHERE symbol IN ('A', 'R')),
mj AS (SELECT open_time_ms, count(*) AS n, sum(CAST(close > ema1200 AS INT) + CAST(ema1200 > old AS INT)) / 4.0 AS trend, avg(now4) > 0 AND avg(then4) > 0 AS persistent FROM mj0 WHERE rn >= 1369 AND ema1200 IS NOT NULL AND old IS NOT NULL GROUP BY ALL),
rg0 AS (SELECT *, coalesce(n = 2 AND votes > 0, FALSE) AS known, 0.4 * CAST(persistent AS INT) + 0.3 * trend + 0.3 * least(breadth / 0.6, 1.0) AS raw FROM (SELECT DISTINCT open_time_ms FROM ind) LEFT JOIN br USING (open_time_ms) LEFT JOIN mj USING (open_time_ms)),
regime AS MATERIALIZED (SELECT open_time_ms, CASE WHEN NOT known THEN 'UNKNOWN' WHEN persistent AND trend >= 0.75 AND breadth >= 0.6 THEN 'BULL' WHEN raw >= 0.55 THEN 'TRANSITION' ELSE 'OFF' END AS state, CASE WHEN known THEN raw ELSE 0 END AS score, coalesce(breadth, 0) AS breadth,
  CASE WHEN known THEN trend ELSE 0 END AS trend_fraction, known AND coalesce(persistent, FALSE) AS persistent_up, coalesce(votes, 0) AS votes FROM rg0)"""


def indicator_frame(spark, sf):
    return mk.indicators(calm(spark, sf))


_SHOWN = ("ema20", "ema50", "ema200", "ema576", "ema1200", "atr", "rsi", "sigma", "vz", "vol_ratio", "quote288")


@query(f"WITH RECURSIVE {IND} SELECT symbol, open_time_ms, {', '.join(f'round({c}, 5) AS {c}' for c in _SHOWN)}, hi144, lo24, squeeze, recent_squeeze FROM ind")
def indicators(spark, sf):
    """EMAs, ATR, RSI, deviations, extremes and squeeze flags of every candle."""
    return rounded(indicator_frame(spark, sf).select("symbol", "open_time_ms", *_SHOWN, "hi144", "lo24", "squeeze", "recent_squeeze"), 5, *_SHOWN)


def study_frame(spark, sf):
    return mk.with_fall_levels(mk.with_breadth(mk.with_benchmark(indicator_frame(spark, sf), "A")))


STUDY_HITS = BENCH + ", hits AS (" + " UNION ALL ".join(f"SELECT symbol, open_time_ms, '{k}' AS rule FROM wide WHERE {p}" for k, p in RULES.items()) + ")"


@query(f"WITH RECURSIVE {STUDY_HITS} SELECT * FROM hits")
def study_rules(spark, sf):
    """Every study rule on daily candles, with benchmark, breadth and fall levels."""
    return mk.hits(study_frame(spark, sf), RULES)


@query(f"WITH RECURSIVE {STUDY_HITS} SELECT symbol, open_time_ms, string_agg(DISTINCT rule, '+' ORDER BY rule) AS rules, count(DISTINCT rule) AS n FROM hits GROUP BY ALL")
def rule_sets(spark, sf):
    """The set of study rules that hold at each candle."""
    return mk.rule_sets(mk.hits(study_frame(spark, sf), RULES))


@query(f"WITH RECURSIVE {REGIME} SELECT open_time_ms, state, round(score, 6) AS score, round(breadth, 6) AS breadth, round(trend_fraction, 6) AS trend_fraction, persistent_up, votes FROM regime")
def bull_regime(spark, sf):
    """Market regime of each day from breadth and the trends of two majors."""
    return rounded(mk.bull_regime(indicator_frame(spark, sf), ("A", "R")), 6, "score", "breadth", "trend_fraction")


def _live_sql() -> str:
    rules = mk.live_conditions(**LIVE)
    marks = ", ".join(f"coalesce({c}, FALSE) AS c_{k}" for k, (c, _, _) in rules.items())
    edges = ", ".join(f"c_{k} AND NOT coalesce({lag(f'c_{k}', 1)}, TRUE) AS e_{k}" for k in rules)
    quiet = ", ".join(f"e_{k} AND coalesce(max(CAST(e_{k} AS INT)) OVER ({P} 11 PRECEDING AND 1 PRECEDING), 0) = 0 AS f_{k}" for k in rules)
    rows = " UNION ALL ".join(f"SELECT symbol, open_time_ms, '{k}' AS family, round({s}, 6) AS score FROM l3 WHERE f_{k} AND {m}" for k, (_, m, s) in rules.items())
    return REGIME + f""",
l0 AS (SELECT ind.*, coalesce(regime.state IN ('BULL', 'TRANSITION'), FALSE) AS gate, least(greatest(sum(taker_buy_base) OVER w12 / nullif(sum(volume) OVER w12, 0), 0), 1) AS taker12 FROM ind JOIN regime USING (open_time_ms) WINDOW w12 AS ({P} 11 PRECEDING AND CURRENT ROW)),
l1 AS (SELECT *, {marks} FROM l0), l2 AS (SELECT *, {edges} FROM l1), l3 AS (SELECT *, {quiet} FROM l2),
b3 AS (SELECT *, quantile_cont(r288, 0.9) OVER (PARTITION BY open_time_ms) AS now_cut, quantile_cont(pr288, 0.9) OVER (PARTITION BY open_time_ms) AS prior_cut, count(*) OVER (PARTITION BY open_time_ms) AS n FROM l0 WHERE pr288 IS NOT NULL)
SELECT * FROM ({rows} UNION ALL SELECT symbol, open_time_ms, 'B3', round(1.0 + least(greatest((r288 - now_cut) * 10000, 0) / 50.0, 2.0), 6) FROM b3 WHERE gate AND n >= 3 AND r288 >= now_cut AND pr288 < prior_cut AND r6 > 0)"""


@query(f"WITH RECURSIVE {_live_sql()}")
def live_rules(spark, sf):
    """The live families F1-F3 and B1-B4: edges with a quiet time, scores, and the B families gated by the market's regime."""
    ind = mk.live_frame(calm(spark, sf), **LIVE)
    regime = mk.bull_regime(ind, ("A", "R")).select("open_time_ms", F.col("state").isin("BULL", "TRANSITION").alias("bullish"))
    return rounded(mk.live_families(ind.join(regime, "open_time_ms"), F.col("bullish"), 3, **LIVE), 6, "score")


@query(f"""WITH {CALM}, t AS (SELECT *, row_number() OVER w AS rn, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) / nullif(close, 0) * 10000 AS range_bps, sum(volume) OVER (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS s12,
  sum(taker_buy_base) OVER (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS t12, lag(close, 288) OVER w AS c288 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time_ms)),
x AS (SELECT symbol, max(rn) AS last FROM t GROUP BY symbol), y AS (SELECT t.*, last FROM t JOIN x USING (symbol)),
h AS (SELECT symbol, quantile_cont(s12, 0.5) AS base FROM y WHERE (last - rn) % 12 = 0 AND last - rn BETWEEN 12 AND 288 GROUP BY symbol), v AS (SELECT symbol, quantile_cont(range_bps, 0.5) AS volatility FROM y WHERE last - rn < 24 GROUP BY symbol)
SELECT symbol, open_time_ms, round((close / c288 - 1) * 100, 6) AS return_pct, round(CASE WHEN rn >= 300 AND base > 0 THEN s12 / base END, 6) AS volume_ratio, round(least(greatest(t12 / nullif(s12, 0), 0), 1), 6) AS taker_ratio, round(volatility, 5) AS volatility_bps,
  row_number() OVER (ORDER BY close / c288 DESC, symbol)::INT AS rank, count(*) OVER () AS universe FROM y JOIN h USING (symbol) JOIN v USING (symbol) WHERE rn = last AND rn >= 289""")
def market_context(spark, sf):
    return rounded(rounded(mk.market_context(calm(spark, sf)), 6, "return_pct", "volume_ratio", "taker_ratio"), 5, "volatility_bps")


SCOUT = CALM + f""", sx AS (SELECT *, greatest(high - low, abs(high - {lag('close', 1)}), abs(low - {lag('close', 1)})) AS tr FROM bars),
{_ewm('se', 'sx', {f'e{n}': ('close', f'(2.0 / {n + 1})') for n in (20, 50, 200)})}, sb AS (SELECT open_time_ms, close AS b_close FROM bars WHERE symbol = 'A'),
s0 AS (SELECT sx.*, rn, CASE WHEN rn >= 20 THEN e20 END AS ema20, CASE WHEN rn >= 50 THEN e50 END AS ema50, CASE WHEN rn >= 200 THEN e200 END AS ema200, b_close FROM sx JOIN se USING (symbol, open_time_ms) LEFT JOIN sb USING (open_time_ms)),
s1 AS (SELECT *, (close / {lag('close', 24)} - 1) * 100 AS return24, (close / {lag('close', 168)} - 1) * 100 AS return7d, ((close / {lag('close', 24)}) / (b_close / {lag('b_close', 24)}) - 1) * 100 AS rs24, ((close / {lag('close', 168)}) / (b_close / {lag('b_close', 168)}) - 1) * 100 AS rs7d,
  {_full('sum({x})', 'quote_volume', 23)} AS quote24, {_full('sum({x})', 'quote_volume', 3)} / nullif({_full('avg({x})', 'quote_volume', 171, 4)} * 4, 0) AS volume4, ({_full('max({x})', 'high', 23)} / {_full('min({x})', 'low', 23)} - 1) * 100 AS span24, {_full('max({x})', 'high', 168, 1)} AS high168,
  {_full('sum({x})', 'taker_buy_base', 3)} / nullif({_full('sum({x})', 'volume', 3)}, 0) AS taker_ratio, {lag('ema50', 24)} AS ema50_24, {lag('ema20', 1)} AS pema20, {lag('close', 1)} AS pc, {_full('avg({x})', 'tr', 13)} / close * 100 AS atr_pct FROM s0),
scout AS MATERIALIZED (SELECT symbol, open_time_ms, close, return24, return7d, rs24, rs7d, quote24, volume4, {lag('span24', 4)} / nullif({_full('quantile_cont({x}, 0.5)', 'span24', 191, 24)}, 0) AS compression, atr_pct, (close / high168 - 1) * 100 AS breakout_pct, (close - low) / nullif(high - low, 0) AS close_position, taker_ratio,
  coalesce(close > ema20 AND ema20 > ema50 AND ema50 > ema50_24, FALSE) AS trend, coalesce(close > ema50 AND ema50 > ema200 AND ema50 > ema50_24 AND return7d > 0, FALSE) AS macro_trend, coalesce(pc <= pema20 AND close > ema20 AND abs(close / ema20 - 1) <= 0.02, FALSE) AS retest, rn > 335 AS ready FROM s1)"""
_SCOUT_NUMBERS = ("return24", "return7d", "rs24", "rs7d", "quote24", "volume4", "compression", "atr_pct", "breakout_pct", "close_position", "taker_ratio")


@query(f"WITH RECURSIVE {SCOUT} SELECT symbol, open_time_ms, {', '.join(f'round({c}, 5) AS {c}' for c in _SCOUT_NUMBERS)}, trend, macro_trend, retest, ready FROM scout")
def scout_features(spark, sf):
    return rounded(mk.scout_features(calm(spark, sf), "A").drop("close"), 5, *_SCOUT_NUMBERS)


SCOUT_LIMITS = {"rs7d": 0, "volume": 1000, "atr": 6, "rise": 15, "week": 40}


@query(f"""WITH RECURSIVE {SCOUT}, c AS (SELECT *, {mk.SCOUT_SCORE} AS raw, CASE {' '.join(f"WHEN {p} THEN '{n}'" for n, _, p in mk.SCOUT)} END AS strategy, CASE {' '.join(f"WHEN {p} THEN '{s}'" for _, s, p in mk.SCOUT)} END AS stage FROM scout WHERE {mk.SCOUT_GATE.format(**SCOUT_LIMITS)})
SELECT symbol, open_time_ms, strategy, stage, round(raw, 2) AS score, round(least(6.0, greatest(2.0, 2 * atr_pct)), 6) AS stop_pct FROM c WHERE strategy IS NOT NULL AND raw >= CASE WHEN stage = 'WATCH' THEN 10 ELSE 20 END""")
def scout_candidates(spark, sf):
    return rounded(mk.scout_candidates(mk.scout_features(calm(spark, sf), "A"), 20, 10, **SCOUT_LIMITS), 6, "stop_pct")


@query(f"""WITH RECURSIVE {SCOUT}, g AS (SELECT open_time_ms, count(*) FILTER (ready) AS nr, count(*) FILTER (ready AND return24 > 0) AS nu, count(*) FILTER (symbol IN ('A', 'R')) AS nm, count(*) FILTER (symbol IN ('A', 'R') AND macro_trend) AS nt FROM scout GROUP BY ALL HAVING count(*) FILTER (symbol IN ('A', 'R')) = 2),
b AS (SELECT open_time_ms, nr / (SELECT count(DISTINCT symbol) FROM scout) AS coverage, nu / nullif(nr, 0) AS breadth, nt FROM g), r AS (SELECT *, coalesce(nt = 2 AND coverage >= 0.8 AND breadth >= 0.6, FALSE) AS raw_bull, coalesce(open_time_ms - lag(open_time_ms) OVER (ORDER BY open_time_ms) = {DAY}, FALSE)::INT AS ok FROM b)
SELECT open_time_ms, round(coverage, 6) AS coverage, round(breadth, 6) AS breadth, raw_bull, sum(raw_bull::INT) OVER (ORDER BY open_time_ms ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AND sum(ok) OVER (ORDER BY open_time_ms ROWS BETWEEN 0 PRECEDING AND CURRENT ROW) = 1 AS established FROM r""")
def established_bull(spark, sf):
    return rounded(mk.established_bull(mk.scout_features(calm(spark, sf), "A"), ("A", "R"), DAY, need=2), 6, "coverage", "breadth")


@query(f"""WITH RECURSIVE {CALM}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms DESC) AS back FROM bars), t AS (SELECT * FROM n WHERE back <= 90), {_ewm('me', 't', {'e9': ('close', '(2.0 / 10)'), 'e21': ('close', '(2.0 / 22)')})},
g AS (SELECT symbol, count(*) AS n, min(open_time_ms) AS a, max(open_time_ms) AS z, max(high) FILTER (back BETWEEN 2 AND 31) AS hi, sum(quote_volume) FILTER (back <= 3) AS q3, avg(quote_volume) FILTER (back BETWEEN 4 AND 63) * 3 AS q60 FROM t GROUP BY symbol),
x AS (SELECT t.*, e9, e21, (close / hi - 1) * 100 AS bp, CASE WHEN q60 > 0 THEN q3 / q60 ELSE 0 END AS vr, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0 END AS cp FROM t JOIN g USING (symbol) JOIN me USING (symbol, open_time_ms) WHERE back = 1 AND n = 90 AND z - a = {89 * DAY})
SELECT symbol, open_time_ms, round(e9, 6) AS ema9, round(e21, 6) AS ema21, round(bp, 6) AS breakout_pct, round(vr, 6) AS volume_ratio, round(cp, 6) AS close_position, close > e9 AND e9 > e21 AND bp > 0 AND bp <= 0.5 AND vr >= 1.5 AND cp >= 0.7 AS triggered FROM x""")
def minute_trigger(spark, sf):
    """The short-candle trigger, read on each symbol's last 90 daily candles."""
    return rounded(mk.minute_trigger(calm(spark, sf), DAY, 90), 6, "ema9", "ema21", "breakout_pct", "volume_ratio", "close_position")


_CASES = [(n, f"rn >= {n} AND max(high) OVER r{n} > min(low) OVER r{n} AND max(high) OVER r{n} - min(low) OVER r{n} <= 2 * atr") for n in range(20, 61)]


@query(f"""WITH RECURSIVE {IND}, f AS (SELECT *, (CASE {' '.join(f'WHEN {c} THEN {n}' for n, c in _CASES)} END)::INT AS n FROM ind WINDOW {', '.join(f'r{n} AS ({P} {n - 1} PRECEDING AND CURRENT ROW)' for n, _ in _CASES)})
SELECT a.symbol, a.open_time_ms, a.n, min(b.low) AS range_low, max(b.high) AS range_high FROM f a JOIN f b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - a.n + 1 AND a.rn WHERE a.n IS NOT NULL GROUP BY ALL""")
def accumulation_ranges(spark, sf):
    """The shortest narrow range that ends at each candle."""
    return mk.accumulation(calm(spark, sf))
