"""Registered selection, gate and report queries with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import models as md
from candela.operators import selectors as sl
from candela.plans.catalog import DAY, TRADES, query, rounded, trades_1d
from candela.plans.ledgers import LEDGER, _wilson
from candela.plans.models import SCORED, _low, scored
from candela.sources.ledger import signals


def capacity_sql(name: str, rows: str, keys: str, order: str, cap: int) -> str:
    """``name``: keys and id of the rows (id, symbol, entry_ms, exit_ms) that a portfolio takes; a place is free only after an exit."""
    both = " AND ".join(f"o.{k} = f.{k}" for k in keys.split(", "))
    return f"""{name}_o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS k FROM {rows}),
{name}_f AS (SELECT DISTINCT {keys}, 0::BIGINT AS k, CAST(NULL AS BIGINT) AS id, []::STRUCT(s VARCHAR, t BIGINT)[] AS places, FALSE AS ok FROM {name}_o
  UNION ALL SELECT {keys}, k, id, CASE WHEN ok THEN list_append(kept, {{'s': symbol, 't': exit_ms}}) ELSE kept END, ok FROM (
  SELECT *, len(kept) < {cap} AND len(list_filter(kept, lambda p: p.s = symbol)) = 0 AS ok FROM (SELECT {', '.join(f'o.{k}' for k in keys.split(', '))}, o.k, o.id, o.symbol, o.exit_ms, list_filter(f.places, lambda p: p.t >= o.entry_ms) AS kept FROM {name}_f f JOIN {name}_o o ON {both} AND o.k = f.k + 1))),
{name} AS MATERIALIZED (SELECT {keys}, id FROM {name}_f WHERE ok)"""


def ci_sql(name: str, rows: str, keys: str, block: str, value: str, least: int = 5) -> str:
    """``name``: keys, blocks, low, high of the mean of whole blocks, 200 draws."""
    return f"""{name}_b AS (SELECT {keys}, {block} AS b, sum({value}) AS s, count({value}) AS n FROM {rows} WHERE {value} IS NOT NULL GROUP BY ALL),
{name}_i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY b) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS m FROM {name}_b),
{name}_d AS (SELECT {keys}, draw, m, (((draw * 1000003 + i * 7919 + 7 * 104729) % 2147483647) * 48271 % 2147483647) % m AS i FROM {name}_i, (SELECT unnest(generate_series(0, 199)) AS draw) WHERE m >= {least}),
{name}_m AS (SELECT {keys}, draw, sum(s) / sum(n) AS mean FROM {name}_d JOIN {name}_i USING ({keys}, i) GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT {keys}, count(*) AS blocks FROM {name}_b GROUP BY {keys}) LEFT JOIN (SELECT {keys}, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM {name}_m GROUP BY {keys}) USING ({keys}))"""


#: Signals as trades of their strategy, open for a day and a half to six days.
VARIANTS = LEDGER + f""", tv AS MATERIALIZED (SELECT id, strategy AS variant, symbol, bar_ms AS signal_ms, bar_ms + 1 AS entry_ms, bar_ms + horizon * 8640000 AS exit_ms, gross, bar_ms // {7 * DAY} AS w FROM ledger)"""
SELECTION = VARIANTS + f""", past AS (SELECT *, w + unnest([1, 2, 3, 4]) AS week FROM tv),
{capacity_sql('made', 'past', 'week, variant', 'entry_ms, symbol, id', 3)},
settled AS MATERIALIZED (SELECT * FROM past SEMI JOIN made USING (week, variant, id) WHERE exit_ms < week * {7 * DAY}),
{ci_sql('ci', 'settled', 'week, variant', f'signal_ms // {DAY}', '(gross - 30)')},
gg AS (SELECT week, variant, count(*) AS n, count(DISTINCT signal_ms // {DAY}) AS days, avg(gross - 30) AS mean_net FROM settled GROUP BY ALL),
best AS (SELECT * FROM gg JOIN ci USING (week, variant) WHERE n >= 15 AND days >= 10 AND mean_net > 10 AND low > 0 QUALIFY row_number() OVER (PARTITION BY week ORDER BY low DESC, mean_net DESC, variant) = 1),
chosen AS MATERIALIZED (SELECT week, variant, n, days, mean_net, low FROM (SELECT DISTINCT w AS week FROM tv) LEFT JOIN best USING (week))"""


def variants(spark, sf):
    l = signals(spark, sf)
    return l.select("id", F.col("strategy").alias("variant"), "symbol", F.col("bar_ms").alias("signal_ms"), (F.col("bar_ms") + 1).alias("entry_ms"), (F.col("bar_ms") + F.col("horizon") * F.lit(8_640_000).cast("long")).alias("exit_ms"), "gross")


def selection(spark, sf):
    return sl.rolling_selection(variants(spark, sf), least=15, edge=10.0)


@query(f"WITH RECURSIVE {SELECTION} SELECT week, variant, n, days, round(mean_net, 6) AS mean_net, round(low, 5) AS low FROM chosen")
def rolling_selector(spark, sf):
    """Each week's variant by the portfolio results of the four weeks before, with the lower bound of a daily block interval."""
    return rounded(rounded(selection(spark, sf), 6, "mean_net"), 5, "low")


_OOS = SELECTION + f""", tested AS (SELECT 1 AS portfolio, tv.*, week FROM tv JOIN chosen c ON c.week = tv.w AND c.variant = tv.variant), {capacity_sql('oos', 'tested', 'portfolio', 'week, entry_ms, symbol, id', 3)}"""


@query(f"WITH RECURSIVE {_OOS} SELECT id, week, variant, gross - 30 AS net FROM tested SEMI JOIN oos USING (id)")
def selected_trades(spark, sf):
    """The trades that the weekly choices make in one portfolio."""
    t = variants(spark, sf)
    return sl.selected_trades(t, selection(spark, sf)).select("id", "week", "variant", (F.col("gross") - 30).alias("net"))


@query(f"""WITH RECURSIVE {VARIANTS}, {ci_sql('ci', 'tv', 'variant', f'signal_ms // {DAY}', '(gross - 30)')},
g AS (SELECT variant, count(*) AS trades, count(DISTINCT signal_ms // {DAY}) AS days, count(DISTINCT symbol) AS symbols, avg(gross - 30) AS a, avg(gross - 50) AS b FROM tv GROUP BY variant)
SELECT variant, trades, days, symbols, round(a, 6) AS mean_first, round(b, 6) AS mean_second, round(low, 5) AS low, round(high, 5) AS high, a > 0 AS gate_first, b > 0 AS gate_second, coalesce(low > 0, FALSE) AS gate_interval, trades >= 100 AS gate_trades, days >= 15 AS gate_days, symbols >= 2 AS gate_symbols,
  a > 0 AND b > 0 AND coalesce(low > 0, FALSE) AND trades >= 100 AND days >= 15 AND symbols >= 2 AS passed FROM g JOIN ci USING (variant)""")
def promotion_gates(spark, sf):
    """Promotion gates of every variant at 30 and 50 bps with a daily block interval."""
    return rounded(rounded(sl.promotion_gates(variants(spark, sf), ("variant",)), 6, "mean_first", "mean_second"), 5, "low", "high")


@query(f"""WITH RECURSIVE {SCORED}, x AS (SELECT *, avg(target) OVER (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 13 PRECEDING) AS base_p, open_time_ms // {24 * DAY} AS block FROM sc), y AS MATERIALIZED (SELECT * FROM x WHERE base_p IS NOT NULL),
bins AS (SELECT symbol, {' + '.join(f'CAST(p >= {i / 10} AS INT)' for i in range(1, 10))} AS b, count(*) AS n, sum(p) AS sp, sum(target) AS sy, sum((p - target) ** 2) AS sq, sum((base_p - target) ** 2) AS sb, sum(CAST((p >= 0.5) = (target = 1) AS INT)) AS ok, sum(CAST((base_p >= 0.5) = (target = 1) AS INT)) AS bok FROM y GROUP BY ALL),
w AS (SELECT symbol, sum(n)::BIGINT AS n, sum(sq) / sum(n) AS brier, sum(sb) / sum(n) AS base_brier, sum(ok) / sum(n) AS accuracy, sum(bok) / sum(n) AS base_accuracy, sum(abs(sp - sy)) / sum(n) AS ece FROM bins GROUP BY symbol),
s AS MATERIALIZED (SELECT *, CASE WHEN p >= 0.5 THEN long_net ELSE short_net END AS net FROM y WHERE p >= 0.6 OR p <= 0.4),
{ci_sql('ci', 's', 'symbol', 'block', 'net', 1)},
g AS (SELECT symbol, count(*) AS signals, count(*) FILTER ((p >= 0.5) = (target = 1)) AS hits, avg(net + 10) AS gross_edge, avg(net) AS net_edge, avg(net + 10) FILTER (net + 10 > 0) AS mean_win, avg(net + 10) FILTER (net + 10 <= 0) AS mean_loss, avg(CAST(touch <> 'NONE' AS INT)) AS resolved, avg(CAST(touch = 'BOTH' AS INT)) AS ambiguous FROM s GROUP BY symbol),
h AS (SELECT *, hits / signals AS signal_accuracy, {_wilson('hits', 'signals', '-')} AS wl, {_wilson('hits', 'signals', '+')} AS wh, {_low(md.bonferroni_z(6))} AS family_low FROM w JOIN g USING (symbol) JOIN ci USING (symbol)),
r AS (SELECT *, list_filter([CASE WHEN signals < 100 THEN 'signals' END, CASE WHEN signal_accuracy < 0.53 THEN 'accuracy' END, CASE WHEN family_low <= 0.5 THEN 'family' END, CASE WHEN brier >= base_brier THEN 'brier' END, CASE WHEN ece > 0.05 THEN 'calibration' END, CASE WHEN net_edge <= 0 THEN 'edge' WHEN blocks < 12 THEN 'blocks' WHEN low <= 0 THEN 'interval' END], lambda z: z IS NOT NULL) AS rs FROM h)
SELECT symbol, n, round(accuracy, 8) AS accuracy, round(base_accuracy, 8) AS base_accuracy, round(brier, 8) AS brier, round(base_brier, 8) AS base_brier, round(ece, 8) AS ece, signals, hits, blocks, round(signal_accuracy, 8) AS signal_accuracy, round(wl, 8) AS low, round(wh, 8) AS high, round(family_low, 8) AS family_low,
  round(gross_edge, 5) AS gross_edge, round(net_edge, 5) AS net_edge, round(low, 5) AS net_low, round(high, 5) AS net_high, round(mean_win, 5) AS mean_win, round(mean_loss, 5) AS mean_loss, round(resolved, 8) AS resolved, round(ambiguous, 8) AS ambiguous, array_to_string(rs, ',') AS reasons, len(rs) = 0 AS passed FROM r""")
def backtest_gates(spark, sf):
    """Backtest measures of each series with a block interval, and the ordered reasons against it. The base probability is the rate of the
    rows that were settled before."""
    from pyspark.sql import Window

    before = Window.partitionBy("symbol").orderBy("open_time_ms").rowsBetween(Window.unboundedPreceding, -13)
    r = scored(spark, sf).withColumns({"base_p": F.avg("target").over(before), "block": F.floor(F.col("open_time_ms") / (24 * DAY)), "cost": F.lit(10.0)}).where("base_p is not null")
    g = sl.backtest_gate(r, ("symbol",))
    return rounded(rounded(g, 8, "accuracy", "base_accuracy", "brier", "base_brier", "ece", "signal_accuracy", "low", "high", "family_low", "resolved", "ambiguous"), 5, "gross_edge", "net_edge", "net_low", "net_high", "mean_win", "mean_loss")


@query(f"""WITH {TRADES}, t AS (SELECT *, gross_bps - 30 AS net FROM trades WHERE gross_bps IS NOT NULL), {ci_sql('ci', 't', 'symbol', f'event_ms // {DAY}', 'net')},
g AS (SELECT symbol, count(*) AS n, count(DISTINCT symbol) AS symbols, count(DISTINCT event_ms // {DAY}) AS days, count(*) FILTER (net > 0) AS wins, avg(CAST(net > 0 AS INT)) AS win_share, avg(net) AS mean_net, quantile_cont(net, 0.5) AS median_net, coalesce(sum(net) FILTER (net > 0), 0) / -sum(net) FILTER (net < 0) AS pf FROM t GROUP BY symbol),
c AS (SELECT symbol, string_agg(coalesce(reason, 'none') || ':' || n, ',' ORDER BY coalesce(reason, 'none') || ':' || n) AS reasons FROM (SELECT symbol, reason, count(*) AS n FROM t GROUP BY ALL) GROUP BY symbol)
SELECT symbol, n, symbols, days, wins, round(win_share, 8) AS win_share, round(mean_net, 6) AS mean_net, round(median_net, 6) AS median_net, round(pf, 6) AS profit_factor, reasons, round(low, 5) AS low, round(high, 5) AS high FROM g JOIN c USING (symbol) JOIN ci USING (symbol)""")
def trade_reports(spark, sf):
    """Trades of each symbol at 30 bps with their exit reasons and a daily block interval."""
    r = sl.trade_report(trades_1d(spark, sf), ("symbol",), 30.0)
    return rounded(rounded(rounded(r, 8, "win_share"), 6, "mean_net", "median_net", "profit_factor"), 5, "low", "high")
