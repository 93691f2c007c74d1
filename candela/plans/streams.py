"""Registered stateful streams with their DuckDB SQL: recursions over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import market as mk
from candela.plans.catalog import BARS_1D, BARS_1H, DAY, HOUR, query
from candela.plans.ledgers import LEDGER
from candela.plans.market import REGIME, indicator_frame
from candela.sources import bars as src
from candela.sources.files import scratch
from candela.sources.ledger import signals
from candela.streaming import state as st

#: Days with day % 97 = 3 are missing; those without votes are unhealthy.
_CLASS, _TARGET, _NEED = st.regime_sql()
_NEXT = "CASE WHEN healthy AND target <> base AND c >= need THEN target ELSE base END"
MACHINE = REGIME + f""",
m0 AS (SELECT *, votes > 0 AND (open_time_ms // {DAY}) % 41 <> 7 AND state <> 'UNKNOWN' AS healthy, row_number() OVER (ORDER BY open_time_ms) AS k FROM regime WHERE (open_time_ms // {DAY}) % 97 <> 3),
m1 AS (SELECT *, {_CLASS} AS class, CASE WHEN score < 0.55 THEN 'OFF' ELSE 'TRANSITION' END AS calm FROM m0),
mach AS (SELECT 0::BIGINT AS k, CAST(NULL AS BIGINT) AS t, CAST(NULL AS VARCHAR) AS raw, CAST(NULL AS VARCHAR) AS now, '' AS wish, 0 AS cnt, CAST(NULL AS VARCHAR) AS event
  UNION ALL SELECT k, t, raw, {_NEXT}, CASE WHEN healthy AND target <> base AND c < need THEN target ELSE '' END, CASE WHEN healthy AND target <> base AND c < need THEN c ELSE 0 END, CASE WHEN k > 1 AND {_NEXT} <> old THEN old || '>' || {_NEXT} END
  FROM (SELECT *, CASE WHEN wish1 = target OR base = 'BULL' AND wish1 IN ('OFF', 'TRANSITION') THEN cnt1 + 1 ELSE 1 END AS c FROM (SELECT *, {_TARGET} AS target, {_NEED} AS need FROM (
    SELECT r.k, r.open_time_ms AS t, r.state AS raw, r.class, r.calm, r.healthy, coalesce(p.now, CASE WHEN NOT r.healthy THEN 'UNKNOWN' WHEN r.state = 'BULL' THEN 'TRANSITION' ELSE r.state END) AS old,
      CASE WHEN NOT r.healthy THEN 'UNKNOWN' WHEN p.now IS NULL THEN CASE WHEN r.state = 'BULL' THEN 'TRANSITION' ELSE r.state END WHEN r.open_time_ms - p.t > {DAY} THEN 'UNKNOWN' ELSE p.now END AS base,
      CASE WHEN r.open_time_ms = p.t + {DAY} THEN p.wish ELSE '' END AS wish1, CASE WHEN r.open_time_ms = p.t + {DAY} THEN p.cnt ELSE 0 END AS cnt1 FROM mach p JOIN m1 r ON r.k = p.k + 1))))
SELECT 'v1|0.6' AS policy, t AS open_time_ms, raw, now AS regime, event FROM mach WHERE k > 0"""


def regime_rows(spark, sf):
    r = mk.bull_regime(indicator_frame(spark, sf), ("A", "R")).where(F.floor(F.col("open_time_ms") / DAY) % 97 != 3)
    healthy = (F.col("votes") > 0) & (F.floor(F.col("open_time_ms") / DAY) % 41 != 7)
    return r.select(F.lit("v1|0.6").alias("policy"), "open_time_ms", "state", "score", "breadth", "trend_fraction", "persistent_up", healthy.alias("healthy"))


@query(f"WITH RECURSIVE {MACHINE}")
def regime_machine(spark, sf):
    """The confirmed regime of each day as a batch fold: one row for each day of one policy."""
    return st.regimes(regime_rows(spark, sf), DAY)


@query(f"WITH RECURSIVE {MACHINE}")
def streamed_regime_machine(spark, sf):
    """The same machine over a stream that arrives in three parts, each run restarted from the checkpoint of the one before."""
    path = scratch(spark, "regime-rows")
    regime_rows(spark, sf).write.parquet(path)
    r = spark.read.parquet(path)
    parts = [r.where("open_time_ms < 850000000000"), r.where("open_time_ms between 850000000000 and 949999999999"), r.where("open_time_ms >= 950000000000")]
    return st.run_parts(spark, parts, lambda rows: st.regimes(rows, DAY), "regime-machine")


@query(f"""WITH {BARS_1D}, d AS (SELECT symbol, open_time_ms, (open_time_ms - lag(open_time_ms) OVER (PARTITION BY symbol ORDER BY open_time_ms)) // {DAY} - 1 AS missing FROM bars) SELECT symbol, open_time_ms, CASE WHEN missing > 0 THEN 'GAP' ELSE 'APPEND' END AS action, coalesce(missing, 0) AS missing FROM d""")
def streamed_appends(spark, sf):
    """Candles appended one by one from a stream that repeats many of them; gaps are reported for a backfill."""
    b = src.bars_1d(spark, sf).select("symbol", "open_time_ms", "close")
    old = b.where("open_time_ms < 900000000000")
    again = b.where(f"open_time_ms >= 900000000000 - {20 * DAY}")
    return st.run_parts(spark, [old, again.unionByName(again.where(f"open_time_ms % {4 * DAY} = 0"))], lambda rows: st.appended(rows, DAY), "appends")


@query(f"""WITH RECURSIVE {LEDGER}, s AS (SELECT symbol || ':' || direction AS key, bar_ms AS t, id, score, row_number() OVER (PARTITION BY symbol, direction ORDER BY bar_ms) AS k FROM ledger QUALIFY count(*) OVER (PARTITION BY symbol, direction, bar_ms) = 1),
s2 AS (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY key ORDER BY t) AS k FROM s),
d AS (SELECT key, k, t, id, t AS sent, score AS best, 'SENT' AS action FROM s2 WHERE k = 1 UNION ALL SELECT r.key, r.k, r.t, r.id, CASE WHEN r.t - d.sent < {5 * DAY} AND r.score < d.best + 1 THEN d.sent ELSE r.t END, CASE WHEN r.t - d.sent < {5 * DAY} AND r.score < d.best + 1 THEN d.best ELSE r.score END, CASE WHEN r.t - d.sent < {5 * DAY} AND r.score < d.best + 1 THEN 'COOLDOWN' ELSE 'SENT' END FROM d JOIN s2 r ON r.key = d.key AND r.k = d.k + 1)
SELECT key, t, id, action FROM d""")
def streamed_deliveries(spark, sf):
    """Deliveries with each id once and a cooldown by symbol and direction, over a stream that repeats signals."""
    l = signals(spark, sf)
    alone = l.groupBy("symbol", "direction", "bar_ms").count().where("count = 1").drop("count")
    s = l.join(alone, ["symbol", "direction", "bar_ms"], "left_semi").select(F.concat_ws(":", "symbol", "direction").alias("key"), F.col("bar_ms").alias("t"), "id", "score", F.timestamp_millis("bar_ms").alias("at"))
    cut = 900_000_000_000
    late = s.where(F.col("t") >= cut)
    return st.run_parts(spark, [s.where(F.col("t") < cut), late.unionByName(late.where("id % 3 = 0"))], lambda rows: st.deliveries(rows, 5 * DAY, 1.0), "deliveries")


@query(f"""WITH RECURSIVE {BARS_1H}, c AS (SELECT symbol AS code, open_time_ms AS t, volume < 3 AS bad, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) AS k FROM bars),
i AS (SELECT code, k, t, CAST(bad AS INT)::BIGINT AS n, -1000000000000000::BIGINT AS sent, FALSE AS due FROM c WHERE k = 1 UNION ALL SELECT c.code, c.k, c.t, CASE WHEN c.bad THEN i.n + 1 ELSE 0 END, CASE WHEN c.bad AND i.n + 1 >= 3 AND c.t - i.sent >= {6 * HOUR} THEN c.t ELSE i.sent END, c.bad AND i.n + 1 >= 3 AND c.t - i.sent >= {6 * HOUR} FROM i JOIN c ON c.code = i.code AND c.k = i.k + 1)
SELECT code, t, n AS failures FROM i WHERE due""")
def streamed_incidents(spark, sf):
    """Incidents after three failing checks in a row, repeated at most every six hours."""
    b = src.bars_1h(spark, sf).select(F.col("symbol").alias("code"), F.col("open_time_ms").alias("t"), (F.col("volume") < 3).alias("bad"))
    return st.run_parts(spark, [b.where("t < 1705000000000"), b.where("t >= 1705000000000")], lambda rows: st.incidents(rows, 6 * HOUR), "incidents")


GRACE = 30 * DAY


@query(f"""WITH {LEDGER}, e AS (SELECT max(greatest(bar_ms, CASE WHEN status IS NOT NULL THEN settled_ms ELSE bar_ms END)) AS w FROM ledger) SELECT id, CASE WHEN status IS NOT NULL THEN 'SETTLED' ELSE 'DATA_MISSING' END AS status, settled_ms AS t FROM ledger, e WHERE status IS NOT NULL OR settled_ms + {GRACE} < w""")
def streamed_lifecycles(spark, sf):
    """Setups that settle at their touch, or are missing once event time has passed their deadline and the grace time."""
    l = signals(spark, sf)
    open_ = l.select("id", F.timestamp_millis("bar_ms").alias("at"), F.col("bar_ms").alias("t"), F.lit("open").alias("kind"), F.col("settled_ms").alias("due"))
    touch = l.where("status is not null").select("id", F.timestamp_millis("settled_ms").alias("at"), F.col("settled_ms").alias("t"), F.lit("touch").alias("kind"), F.lit(0).cast("long").alias("due"))
    e = open_.unionByName(touch)
    path = scratch(spark, "setups")
    e.write.parquet(path)
    e = spark.read.parquet(path)
    # parts follow each other in event time, row by row: none is late, and a setup may settle in a later part than it opens in
    cuts = [None, 850_000_000_000, 930_000_000_000, None]
    parts = [e.where((F.lit(True) if a is None else F.col("t") >= a) & (F.lit(True) if b is None else F.col("t") < b)) for a, b in zip(cuts, cuts[1:])]
    return st.run_parts(spark, parts, lambda rows: st.lifecycles(rows, GRACE), "lifecycles")


@query(f"WITH {BARS_1H} SELECT symbol, max(open_time_ms) AS open_time_ms, arg_max(close, open_time_ms) AS close FROM bars WHERE trade_count % 3 <> 0 GROUP BY symbol")
def streamed_latest(spark, sf):
    """The newest closed candle of each symbol from a stream of JSON lines."""
    b = src.bars_1h(spark, sf)
    path = scratch(spark, "lines")
    b.select(F.to_json(F.struct("symbol", "open_time_ms", "close", (F.col("trade_count") % 3 != 0).alias("closed"))).alias("value")).write.text(path)
    out = scratch(spark, "latest")
    st.latest_closed(spark.readStream.text(path), out)
    return spark.read.parquet(out + "/rows")


@query(f"""WITH {BARS_1H}, g AS (SELECT symbol, open_time_ms - open_time_ms % {4 * HOUR} AS bucket_ms, arg_min(open, open_time_ms) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time_ms) AS close, count(*) AS n FROM bars GROUP BY ALL)
SELECT * EXCLUDE (n) FROM g WHERE n = 4 AND bucket_ms + {4 * HOUR} <= (SELECT max(open_time_ms) FROM bars)""")
def streamed_whole_windows(spark, sf):
    """Four-hour candles from a stream of hourly ones, complete ones only."""
    b = src.bars_1h(spark, sf).select("symbol", F.timestamp_millis("open_time_ms").alias("at"), "open", "high", "low", "close")
    return st.run_parts(spark, [b.where("at < timestamp_millis(1705000000000)"), b.where("at >= timestamp_millis(1705000000000)")], lambda rows: st.whole_windows(rows, 4), "windows")
