"""The library's registered queries and their DuckDB SQL, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candela.functions.ewm import ewm, span
from candela.functions.scalars import frame, guarded, ratio, series, true_range
from candela.operators import events as ev
from candela.operators import summaries as sm
from candela.sources import bars as src
from candela.sources import files as fs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DAY, HOUR = src.DAY, src.HOUR

BARS_1D = """
ticks AS (SELECT l_returnflag AS symbol, epoch_ms(l_shipdate) AS ms, l_extendedprice / l_quantity AS price, l_quantity AS size, l_extendedprice AS value,
  CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0.0 END AS taker, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4 FROM lineitem),
bars AS (SELECT symbol, ms - (ms % 86400000 + 86400000) % 86400000 AS open_time_ms, first(price ORDER BY k1, k2, k3, k4) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY k1, k2, k3, k4) AS close,
  sum(size) AS volume, round(sum(value), 2) AS quote_volume, count(*) AS trade_count, sum(taker) AS taker_buy_base, ms - (ms % 86400000 + 86400000) % 86400000 + 86400000 - 1 AS close_time_ms FROM ticks GROUP BY symbol, ms - (ms % 86400000 + 86400000) % 86400000)"""
# epoch_ms rounds: a tick less than half a millisecond before the hour would go to the next candle
BARS_1H = """
ticks AS (SELECT event_type AS symbol, epoch_ms(date_trunc('milliseconds', ts)) AS ms, value + 1 AS price, CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS taker, ts, event_id FROM events),
bars AS (SELECT symbol, ms - (ms % 3600000 + 3600000) % 3600000 AS open_time_ms, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close,
  CAST(count(*) AS DOUBLE) AS volume, round(sum(price), 2) AS quote_volume, count(*) AS trade_count, CAST(sum(taker) AS DOUBLE) AS taker_buy_base, ms - (ms % 3600000 + 3600000) % 3600000 + 3600000 - 1 AS close_time_ms FROM ticks GROUP BY symbol, ms - (ms % 3600000 + 3600000) % 3600000)"""
W = "(PARTITION BY symbol ORDER BY open_time_ms)"
#: Long trades on 12-row breakouts: next open, +200 / -150 bps, 12 rows, stop first.
TRADES = BARS_1D + """,
lv AS (SELECT *, CASE WHEN count(high) OVER p = 12 THEN max(high) OVER p END AS level, CASE WHEN count(volume) OVER v >= 20 THEN (volume - avg(volume) OVER v) / nullif(stddev_pop(volume) OVER v, 0) END AS z
  FROM bars WINDOW p AS (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
sig AS (SELECT symbol, open_time_ms AS event_ms FROM (SELECT *, lag(close) OVER w AS pc, lag(level) OVER w AS pl FROM lv WINDOW w AS (PARTITION BY symbol ORDER BY open_time_ms)) WHERE close > level AND pc <= pl AND z >= 0),
ent AS (SELECT s.symbol, s.event_ms, b.open AS entry FROM sig s JOIN bars b ON b.symbol = s.symbol AND b.open_time_ms = s.event_ms + 86400000),
path AS (SELECT e.*, (b.open_time_ms - e.event_ms) // 86400000 AS k, b.open, b.high, b.low, b.close FROM ent e JOIN bars b ON b.symbol = e.symbol AND b.open_time_ms > e.event_ms AND b.open_time_ms <= e.event_ms + 12 * 86400000),
marked AS (SELECT *, CASE WHEN low <= entry * (1 - 150 / 10000.0) THEN CASE WHEN open <= entry * (1 - 150 / 10000.0) AND k > 1 THEN 'STOP_GAP' ELSE 'STOP' END
  WHEN high >= entry * (1 + 200 / 10000.0) THEN CASE WHEN open >= entry * (1 + 200 / 10000.0) AND k > 1 THEN 'TARGET_GAP' ELSE 'TARGET' END END AS r FROM path),
agg AS (SELECT symbol, event_ms, entry, count(*) AS n_bars, min(k) FILTER (r IS NOT NULL) AS hk, arg_min(r, k) FILTER (r IS NOT NULL) AS hr, arg_min(open, k) FILTER (r IS NOT NULL) AS ho, max(close) FILTER (k = 12) AS last_close FROM marked GROUP BY ALL),
seen AS (SELECT a.*, CASE WHEN hk IS NOT NULL THEN (SELECT count(*) FROM path p WHERE p.symbol = a.symbol AND p.event_ms = a.event_ms AND p.k <= a.hk) = hk ELSE n_bars = 12 END AS ok FROM agg a),
outc AS (SELECT symbol, event_ms, entry, CASE WHEN NOT ok THEN 'DATA_MISSING' ELSE coalesce(hr, 'TIME_EXIT') END AS reason, CASE WHEN ok THEN coalesce(hk, 12) END AS held,
  CASE WHEN ok THEN CASE WHEN hr LIKE '%GAP' THEN ho WHEN hr = 'STOP' THEN entry * (1 - 150 / 10000.0) WHEN hr = 'TARGET' THEN entry * (1 + 200 / 10000.0) ELSE last_close END END AS exit FROM seen),
trades AS (SELECT *, (exit / entry - 1) * 10000 AS gross_bps, (exit / entry - 1) * 10000 - 10 AS net_bps FROM outc)"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def trades_1d(spark: SparkSession, sf: str) -> DataFrame:
    bars = src.bars_1d(spark, sf)
    return ev.bracket_outcomes(ev.breakouts(bars).where("fires"), bars, DAY, 12, 200, 150)


@query(f"WITH {BARS_1D} SELECT * FROM bars")
def bars_1d(spark, sf):
    return src.bars_1d(spark, sf)


@query(f"WITH {BARS_1H} SELECT * FROM bars")
def bars_1h(spark, sf):
    return src.bars_1h(spark, sf)


@query(f"""WITH {BARS_1H} SELECT symbol, open_time_ms - open_time_ms % 14400000 AS bucket_ms, arg_min(open, open_time_ms) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time_ms) AS close,
  sum(volume) AS volume, sum(trade_count)::BIGINT AS trade_count FROM bars GROUP BY ALL HAVING count(*) = 4""")
def resample_complete(spark, sf):
    return src.resample(src.bars_1h(spark, sf), HOUR, 4 * HOUR)


@query(f"""WITH {BARS_1H}, bad AS (SELECT symbol, CASE WHEN low * CASE WHEN trade_count % 7 = 0 THEN -1 ELSE 1 END <= 0 THEN 'price' WHEN taker_buy_base * CASE WHEN trade_count % 5 = 0 THEN 3 ELSE 1 END > volume * 1.0001 + 1e-8 THEN 'taker' END AS violation FROM bars)
SELECT symbol, coalesce(violation, 'ok') AS violation, count(*) AS n FROM bad GROUP BY ALL""")
def candle_validation(spark, sf):
    """Candles damaged by a rule, then counted by the first rule they break."""
    bars = src.bars_1h(spark, sf).withColumn("low", F.col("low") * F.when(F.col("trade_count") % 7 == 0, -1).otherwise(1))
    bars = bars.withColumn("taker_buy_base", F.col("taker_buy_base") * F.when(F.col("trade_count") % 5 == 0, 3).otherwise(1))
    return src.validated(bars, HOUR).groupBy("symbol", F.coalesce("violation", F.lit("ok")).alias("violation")).agg(F.count("*").alias("n"))


@query(f"""WITH {BARS_1H}, g AS (SELECT *, CASE WHEN open_time_ms - lag(open_time_ms) OVER {W} <> 3600000 THEN open_time_ms END AS gap FROM bars), l AS (SELECT *, max(gap) OVER (PARTITION BY symbol) AS last_gap FROM g)
SELECT symbol, open_time_ms, close FROM l WHERE last_gap IS NULL OR open_time_ms >= last_gap""")
def contiguous_tail(spark, sf):
    return src.contiguous_tail(src.bars_1h(spark, sf), HOUR).select("symbol", "open_time_ms", "close")


@query(f"""WITH {BARS_1H}, g AS (SELECT *, sum(gap) OVER {W} AS segment FROM (SELECT *, CASE WHEN open_time_ms - lag(open_time_ms) OVER {W} <> 3600000 THEN 1 ELSE 0 END AS gap FROM bars)),
s AS (SELECT symbol, segment, count(*) AS n, min(open_time_ms) AS start_ms, max(open_time_ms) AS end_ms FROM g GROUP BY ALL)
SELECT symbol, n, start_ms, end_ms FROM s QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, segment) = 1""")
def longest_segment(spark, sf):
    return src.longest_segment(src.bars_1h(spark, sf), HOUR)


@query(f"""WITH {BARS_1H}, g AS (SELECT symbol, (open_time_ms - lag(open_time_ms) OVER {W}) // 3600000 AS d FROM bars)
SELECT symbol, count(*) AS bars, count(*) FILTER (d > 1) AS gaps, CAST(coalesce(sum(d - 1) FILTER (d > 1), 0) AS BIGINT) AS missing, max(d) AS largest FROM g GROUP BY symbol""")
def grid_gaps(spark, sf):
    return src.grid_gaps(src.bars_1h(spark, sf), HOUR)


@query(f"""WITH {BARS_1D}, new_rows AS (SELECT symbol, open_time_ms, close * 2 AS close, volume FROM bars WHERE open_time_ms % (5 * 86400000) = 0)
SELECT b.symbol, b.open_time_ms, coalesce(n.close, b.close) AS close, b.volume FROM bars b LEFT JOIN new_rows n USING (symbol, open_time_ms)""")
def keep_last_union(spark, sf):
    old = src.bars_1d(spark, sf).select("symbol", "open_time_ms", "close", "volume")
    return src.keep_last(old, old.where(F.col("open_time_ms") % (5 * DAY) == 0).withColumn("close", F.col("close") * 2))


def ewm_sql(source: str, value: str, alpha: str, where: str = "TRUE") -> str:
    return f"""o AS (SELECT symbol, open_time_ms, {value} AS x, row_number() OVER {W} AS rn FROM {source} WHERE {where}),
e AS (SELECT symbol, open_time_ms, rn, x AS y FROM o WHERE rn = 1 UNION ALL SELECT o.symbol, o.open_time_ms, o.rn, {alpha} * o.x + (1 - {alpha}) * e.y FROM e JOIN o ON o.symbol = e.symbol AND o.rn = e.rn + 1)"""


@query(f"WITH RECURSIVE {BARS_1D}, {ewm_sql('bars', 'close', '(2.0 / 51)')} SELECT symbol, open_time_ms, CASE WHEN rn >= 50 THEN round(y, 6) END AS ema50 FROM e")
def ewm_50(spark, sf):
    return rounded(ewm(src.bars_1d(spark, sf), "close", span(50), "ema50", 50).select("symbol", "open_time_ms", "ema50"), 6, "ema50")


@query(f"""WITH RECURSIVE {BARS_1D}, tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS t FROM bars), {ewm_sql('tr', 't', '(1.0 / 14)')}
SELECT b.symbol, b.open_time_ms, round(t, 6) AS true_range, CASE WHEN rn >= 14 THEN round(y, 6) END AS atr_wilder,
  round(CASE WHEN count(t) OVER m >= 14 THEN avg(t) OVER m END, 6) AS atr_mean FROM tr b JOIN e USING (symbol, open_time_ms) WINDOW m AS (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""")
def atr_variants(spark, sf):
    w = series()
    r = src.bars_1d(spark, sf).withColumn("true_range", true_range(w))
    r = r.withColumn("atr_mean", guarded(F.avg, F.col("true_range"), frame(w, 14), 14))
    return rounded(ewm(r, "true_range", 1 / 14, "atr_wilder", 14).select("symbol", "open_time_ms", "true_range", "atr_wilder", "atr_mean"), 6, "true_range", "atr_wilder", "atr_mean")


@query(f"""WITH RECURSIVE {BARS_1D}, d AS (SELECT symbol, open_time_ms, close - lag(close) OVER {W} AS c FROM bars),
o AS (SELECT symbol, open_time_ms, greatest(c, 0) AS g, greatest(-c, 0) AS l, row_number() OVER {W} AS rn FROM d WHERE c IS NOT NULL),
e AS (SELECT symbol, open_time_ms, rn, g, l FROM o WHERE rn = 1 UNION ALL SELECT o.symbol, o.open_time_ms, o.rn, (1.0 / 14) * o.g + (1 - 1.0 / 14) * e.g, (1.0 / 14) * o.l + (1 - 1.0 / 14) * e.l FROM e JOIN o ON o.symbol = e.symbol AND o.rn = e.rn + 1)
SELECT symbol, open_time_ms, round(((CASE WHEN g = 0 THEN 0 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END) - 50) / 25, 6) AS rsi_centred FROM e WHERE rn >= 14""")
def rsi_centred(spark, sf):
    c = F.col("close") - F.lag("close").over(series())
    r = src.bars_1d(spark, sf).withColumn("c", c).withColumns({"g": F.when(F.col("c").isNotNull(), F.greatest("c", F.lit(0.0))), "l": F.when(F.col("c").isNotNull(), F.greatest(-F.col("c"), F.lit(0.0)))})
    r = ewm(ewm(r.select("symbol", "open_time_ms", "g", "l"), "g", 1 / 14, "eg", 14), "l", 1 / 14, "el", 14).where("eg is not null")
    rsi = F.when(F.col("eg") == 0, 0.0).when(F.col("el") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("eg") / F.nullif("el", F.lit(0.0))))
    return r.select("symbol", "open_time_ms", F.round((rsi - 50) / 25, 6).alias("rsi_centred"))


@query(f"""WITH {BARS_1D} SELECT symbol, open_time_ms, round(CASE WHEN count(close) OVER a >= 20 THEN avg(close) OVER a END, 6) AS mean20, round(CASE WHEN count(close) OVER a >= 20 THEN stddev_pop(close) OVER a END, 6) AS pop20,
  round(CASE WHEN count(close) OVER c >= 24 THEN stddev_samp(close) OVER c END, 6) AS samp48, CASE WHEN count(high) OVER p = 24 THEN max(high) OVER p END AS prior_high, CASE WHEN count(low) OVER p = 24 THEN min(low) OVER p END AS prior_low,
  round(CASE WHEN count(volume) OVER p >= 18 THEN quantile_cont(volume, 0.5) OVER p END, 6) AS median_prior FROM bars
WINDOW a AS (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), c AS (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 47 PRECEDING AND CURRENT ROW), p AS (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)""")
def rolling_windows(spark, sf):
    w = series()
    close, prior = F.col("close"), frame(w, 24, -1)
    median = F.when(F.count("volume").over(prior) >= 18, F.percentile("volume", 0.5).over(prior))
    r = src.bars_1d(spark, sf).select("symbol", "open_time_ms", guarded(F.avg, close, frame(w, 20), 20).alias("mean20"), guarded(F.stddev_pop, close, frame(w, 20), 20).alias("pop20"),
        guarded(F.stddev_samp, close, frame(w, 48), 24).alias("samp48"), guarded(F.max, F.col("high"), prior, 24).alias("prior_high"), guarded(F.min, F.col("low"), prior, 24).alias("prior_low"), median.alias("median_prior"))
    return rounded(r, 6, "mean20", "pop20", "samp48", "median_prior")


@query(f"""WITH {BARS_1D}, t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS tr, ln(1 + volume) AS lv FROM bars),
a AS (SELECT *, greatest((CASE WHEN count(tr) OVER m >= 14 THEN avg(tr) OVER m END) / nullif(close, 0), CASE WHEN count(tr) OVER m >= 14 THEN 1e-9 ELSE 1e-9 END) AS atr_pct, count(*) OVER b AS nb, avg(close) OVER b AS mc, stddev_pop(close) OVER b AS sc, avg(lv) OVER b AS mv, stddev_pop(lv) OVER b AS sv,
  lag(close, 1) OVER w AS c1, lag(close, 3) OVER w AS c3, lag(close, 12) OVER w AS c12 FROM t
  WINDOW m AS (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w AS (PARTITION BY symbol ORDER BY open_time_ms))
SELECT symbol, open_time_ms, round(ln(close / c1) / atr_pct, 5) AS momentum_1, round(ln(close / c3) / atr_pct, 5) AS momentum_3, round(ln(close / c12) / atr_pct, 5) AS momentum_12, round((close - mc) / nullif(sc, 0), 5) AS bollinger_z,
  round((lv - mv) / nullif(sv, 0), 5) AS volume_z, round(ln(atr_pct), 5) AS log_atr_pct, round((2 * close - high - low) / nullif(high - low, 0), 5) AS pressure FROM a WHERE nb >= 20 AND c12 IS NOT NULL""")
def feature_vector(spark, sf):
    cols = ("momentum_1", "momentum_3", "momentum_12", "bollinger_z", "volume_z", "log_atr_pct", "pressure")
    nb = F.count("*").over(frame(series(), 20))
    r = ev.features(src.bars_1d(spark, sf)).withColumn("nb", nb).where("nb >= 20 and bollinger_z is not null")
    return rounded(r.select("symbol", "open_time_ms", *cols), 5, *cols)


@query(f"""WITH {BARS_1D}, bench AS (SELECT open_time_ms, close AS b FROM bars WHERE symbol = 'A'), j AS (SELECT bars.*, b FROM bars LEFT JOIN bench USING (open_time_ms))
SELECT symbol, open_time_ms, round((close / lag(close, 7) OVER {W} - b / lag(b, 7) OVER {W}) * 10000, 5) AS relative_bps FROM j""")
def benchmark_strength(spark, sf):
    bars = src.bars_1d(spark, sf)
    bench = bars.where("symbol = 'A'").select("open_time_ms", F.col("close").alias("b"))
    w = series()
    r = bars.join(bench, "open_time_ms", "left").withColumn("relative_bps", (F.col("close") / F.lag("close", 7).over(w) - F.col("b") / F.lag("b", 7).over(w)) * 10_000)
    return rounded(r.select("symbol", "open_time_ms", "relative_bps"), 5, "relative_bps")


OI = "oi AS (SELECT epoch_ms(o_orderdate) AS t, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1)"


@query(f"""WITH {BARS_1D}, {OI}, c AS (SELECT t, v / nullif(lag(v, 12) OVER (ORDER BY t), 0) - 1 AS change, count(*) OVER (ORDER BY t RANGE BETWEEN {12 * DAY} PRECEDING AND CURRENT ROW) AS n FROM oi)
SELECT symbol, open_time_ms, round(CASE WHEN n = 13 THEN change END, 9) AS oi_change FROM bars LEFT JOIN c ON c.t = bars.open_time_ms - {DAY}""")
def open_interest_change(spark, sf):
    """The open interest known one step before: its change over 12 steps if all 13 points are there."""
    oi = src.read(spark, sf, "orders").groupBy(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("t")).agg(F.count("*").cast("double").alias("v"))
    # one small series: years of days; a single ordered partition is its natural size
    w = Window.orderBy("t")
    c = oi.select((F.col("t") + DAY).alias("open_time_ms"), (ratio(F.col("v"), F.lag("v", 12).over(w)) - 1).alias("change"), F.count("*").over(w.rangeBetween(-12 * DAY, 0)).alias("n"))
    r = src.bars_1d(spark, sf).join(c, "open_time_ms", "left")
    return r.select("symbol", "open_time_ms", F.round(F.when(F.col("n") == 13, F.col("change")), 9).alias("oi_change"))


@query(f"""WITH {BARS_1H}, f AS (SELECT open_time_ms + 1 AS t, symbol, close AS rate FROM bars WHERE (open_time_ms // 3600000) % 8 = 0)
SELECT b.symbol, b.open_time_ms, f.rate FROM bars b ASOF LEFT JOIN f ON f.symbol = b.symbol AND f.t < b.close_time_ms""")
def asof_funding(spark, sf):
    """The last funding paid before a candle's close: union and last value, no range join."""
    bars = src.bars_1h(spark, sf)
    paid = bars.where(F.floor(F.col("open_time_ms") / HOUR) % 8 == 0).select("symbol", (F.col("open_time_ms") + 1).alias("t"), F.lit(None).cast("long").alias("open_time_ms"), F.col("close").alias("rate"))
    both = bars.select("symbol", F.col("close_time_ms").alias("t"), "open_time_ms", F.lit(None).cast("double").alias("rate")).unionByName(paid)
    w = Window.partitionBy("symbol").orderBy("t", F.col("rate").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("rate", F.last("rate", ignorenulls=True).over(w)).where("open_time_ms is not null").select("symbol", "open_time_ms", "rate")


@query(f"""WITH {BARS_1D}, c AS (SELECT *, close > lag(close) OVER {W} AS up, row_number() OVER {W} AS rn FROM bars), e AS (SELECT *, coalesce(up, FALSE) AND NOT coalesce(lag(coalesce(up, FALSE)) OVER {W}, TRUE) AS edge FROM c),
f AS (SELECT *, edge AND coalesce(max(CAST(edge AS INT)) OVER (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) = 0 AS fires FROM e)
SELECT symbol, open_time_ms FROM f WHERE fires""")
def rising_edges(spark, sf):
    up = F.col("close") > F.lag("close").over(series())
    return ev.with_edges(src.bars_1d(spark, sf).withColumn("up", up), F.col("up"), quiet=3).where("fires").select("symbol", "open_time_ms")


@query(f"""WITH {BARS_1H}, r AS (SELECT *, CASE WHEN volume >= 2 THEN 1 ELSE 0 END AS raw, CASE WHEN open_time_ms - lag(open_time_ms) OVER {W} = 3600000 THEN 1 ELSE 0 END AS ok FROM bars)
SELECT symbol, open_time_ms FROM r QUALIFY sum(raw) OVER (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4 AND sum(ok) OVER (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3""")
def confirmed_runs(spark, sf):
    return ev.confirmed(src.bars_1h(spark, sf), F.col("volume") >= 2, HOUR, 4).where("confirmed").select("symbol", "open_time_ms")


@query(f"""WITH {BARS_1D}, r AS (SELECT symbol, open_time_ms, close / lag(close, 5) OVER {W} - 1 AS ret FROM bars), v AS (SELECT * FROM r WHERE ret IS NOT NULL)
SELECT symbol, open_time_ms, row_number() OVER t AS place, count(*) OVER (PARTITION BY open_time_ms) AS universe, ret >= quantile_cont(ret, 0.9) OVER (PARTITION BY open_time_ms) AS top_decile FROM v WINDOW t AS (PARTITION BY open_time_ms ORDER BY ret DESC, symbol)""")
def cross_section_rank(spark, sf):
    r = src.bars_1d(spark, sf).withColumn("ret", F.col("close") / F.lag("close", 5).over(series()) - 1).where("ret is not null")
    at = Window.partitionBy("open_time_ms")
    return r.select("symbol", "open_time_ms", F.row_number().over(at.orderBy(F.desc("ret"), "symbol")).alias("place"), F.count("*").over(at).alias("universe"), (F.col("ret") >= F.percentile("ret", 0.9).over(at)).alias("top_decile"))


@query(f"""WITH {BARS_1D}, m AS (SELECT *, CASE WHEN count(close) OVER a >= 20 THEN avg(close) OVER a END AS mean20 FROM bars WINDOW a AS (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT open_time_ms, count(mean20) AS eligible, count(*) FILTER (close > mean20) AS bull, round(count(*) FILTER (close > mean20) / nullif(count(mean20), 0), 9) AS breadth FROM m GROUP BY open_time_ms""")
def breadth(spark, sf):
    r = src.bars_1d(spark, sf).withColumn("m", guarded(F.avg, F.col("close"), frame(series(), 20), 20))
    g = r.groupBy("open_time_ms").agg(F.count("m").alias("eligible"), F.count_if(F.col("close") > F.col("m")).alias("bull"))
    return g.withColumn("breadth", F.round(F.col("bull") / F.nullif("eligible", F.lit(0)), 9))


@query(f"WITH {TRADES} SELECT symbol, event_ms, entry, reason, held, round(exit, 9) AS exit, round(gross_bps, 6) AS gross_bps, round(net_bps, 6) AS net_bps FROM trades")
def breakout_brackets(spark, sf):
    return rounded(rounded(trades_1d(spark, sf), 9, "exit"), 6, "gross_bps", "net_bps")


@query(f"""WITH {TRADES} SELECT symbol, count(*) AS trades, count(DISTINCT symbol) AS symbols, count(DISTINCT event_ms // 86400000) AS days, count(*) FILTER (net_bps > 0) AS wins, round(avg(CASE WHEN net_bps > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS win_pct,
  round(avg(net_bps), 6) AS mean_net, round(quantile_cont(net_bps, 0.5), 6) AS median_net, round(coalesce(sum(net_bps) FILTER (net_bps > 0), 0) / nullif(-coalesce(sum(net_bps) FILTER (net_bps <= 0), 0), 0), 6) AS profit_factor FROM trades WHERE net_bps IS NOT NULL GROUP BY symbol""")
def breakout_summary(spark, sf):
    return sm.trade_summary(trades_1d(spark, sf), "symbol")


@query(f"""WITH {TRADES} SELECT symbol, reason, CAST(grouping(symbol, reason) AS INT) AS level, count(*) AS trades, count(*) FILTER (net_bps > 0) AS wins, round(sum(net_bps), 4) AS total_net FROM trades WHERE net_bps IS NOT NULL GROUP BY CUBE (symbol, reason)""")
def scorecard(spark, sf):
    return sm.scorecard(trades_1d(spark, sf))


@query(f"""WITH {TRADES}, r AS (SELECT symbol, CAST(net_bps > 0 AS INT) AS hit, row_number() OVER (PARTITION BY symbol ORDER BY event_ms DESC) AS r FROM trades WHERE net_bps IS NOT NULL),
g AS (SELECT symbol, l.last, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits FROM r JOIN (VALUES (10), (50), (100)) l(last) ON r.r <= l.last GROUP BY ALL), p AS (SELECT *, hits / n AS p, 1.959963984540054 AS z FROM g)
SELECT symbol, last, n, hits, round(p, 9) AS rate, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 9) AS low,
  round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 9) AS high FROM p""")
def rolling_rates(spark, sf):
    return sm.rolling_rates(trades_1d(spark, sf))


@query(f"""WITH {TRADES}, c AS (SELECT symbol, event_ms, sum(net_bps) OVER (PARTITION BY symbol ORDER BY event_ms) AS c FROM trades WHERE net_bps IS NOT NULL), p AS (SELECT *, max(c) OVER (PARTITION BY symbol ORDER BY event_ms) AS peak FROM c)
SELECT symbol, round(min(c - peak), 4) AS max_drawdown, round(max(c), 4) AS best FROM p GROUP BY symbol""")
def drawdown(spark, sf):
    return sm.drawdown(trades_1d(spark, sf))


NOW = 880_000_000_000


@query(f"""WITH {TRADES}, m AS (SELECT *, event_ms + 12 * 86400000 <= {NOW} AS mature, net_bps IS NOT NULL AS known, coalesce(net_bps > 0, FALSE) AS hit FROM trades),
g AS (SELECT symbol, count(*) AS records, count(*) FILTER (mature) AS matured, count(*) FILTER (mature AND known) AS resolved, count(*) FILTER (NOT mature) AS open, count(*) FILTER (mature AND NOT known) AS missing,
  count(*) FILTER (NOT mature AND known AND hit) AS early_hits, count(*) FILTER (mature AND known AND hit) AS hits FROM m GROUP BY symbol)
SELECT *, CASE WHEN resolved > 0 AND missing = 0 THEN round(hits / resolved, 9) END AS hit_rate FROM g""")
def cohort_maturity(spark, sf):
    return sm.cohort_summary(trades_1d(spark, sf), NOW, 12 * DAY)


#: Means of 200 draws of days for each symbol.
DRAWS = TRADES + """,
b AS (SELECT symbol, event_ms // 86400000 AS day, sum(net_bps) AS s, count(*) AS n FROM trades WHERE net_bps IS NOT NULL GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS m FROM b),
d AS (SELECT symbol, draw, (((draw * 1000003 + i * 7919 + 7 * 104729) % 2147483647) * 48271 % 2147483647) % m AS pick FROM i, (SELECT unnest(generate_series(0, 199)) AS draw)),
means AS (SELECT d.symbol, draw, sum(s) / sum(n) AS mean FROM d JOIN i ON i.symbol = d.symbol AND i.i = d.pick GROUP BY ALL)"""


@query(f"""WITH {DRAWS}
SELECT symbol, count(*) AS draws, round(quantile_cont(mean, 0.025), 5) AS low, round(quantile_cont(mean, 0.975), 5) AS high FROM means GROUP BY symbol""")
def block_bootstrap(spark, sf):
    return sm.block_bootstrap(trades_1d(spark, sf))


@query(f"""WITH {DRAWS}, ci AS (SELECT symbol, round(quantile_cont(mean, 0.025), 5) AS low, round(quantile_cont(mean, 0.975), 5) AS high FROM means WHERE symbol IN (SELECT symbol FROM b GROUP BY symbol HAVING count(*) >= 5) GROUP BY symbol),
rs AS (SELECT symbol, string_agg(reason || ':' || n, ',' ORDER BY reason) AS reasons FROM (SELECT symbol, reason, count(*) AS n FROM trades GROUP BY ALL) GROUP BY symbol)
SELECT symbol, count(*) AS trades, count(DISTINCT symbol) AS symbols, count(DISTINCT event_ms // 86400000) AS days, count(*) FILTER (net_bps > 0) AS wins, round(avg(CASE WHEN net_bps > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS win_pct, round(avg(net_bps), 6) AS mean_net, round(quantile_cont(net_bps, 0.5), 6) AS median_net,
  round(coalesce(sum(net_bps) FILTER (net_bps > 0), 0) / nullif(-coalesce(sum(net_bps) FILTER (net_bps <= 0), 0), 0), 6) AS profit_factor, any_value(reasons) AS reasons, any_value(low) AS low, any_value(high) AS high FROM trades LEFT JOIN rs USING (symbol) LEFT JOIN ci USING (symbol) WHERE net_bps IS NOT NULL GROUP BY symbol""")
def trade_report(spark, sf):
    """The trade summary with exit reasons and the interval of the mean by days."""
    r = rounded(sm.trade_report(fs.kept(trades_1d(spark, sf), "trades")), 5, "low", "high")
    return r.withColumn("reasons", F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat_ws(":", e.key, e.value.cast("string"))), ","))


@query(f"""WITH {BARS_1D}, o AS (SELECT *, row_number() OVER {W} AS rn FROM bars), p AS (SELECT a.symbol, a.open_time_ms, min(b.rn - a.rn) FILTER (b.high >= a.close * exp(0.03)) AS u, min(b.rn - a.rn) FILTER (b.low <= a.close * exp(-0.03)) AS d, max(b.close) FILTER (b.rn - a.rn = 8) AS c8, any_value(a.close) AS c0
  FROM o a JOIN o b ON a.symbol = b.symbol AND b.rn > a.rn AND b.rn <= a.rn + 8 GROUP BY ALL HAVING count(*) = 8)
SELECT symbol, open_time_ms, CASE WHEN u IS NULL AND d IS NULL THEN 'NONE' WHEN u = d THEN 'BOTH' WHEN d IS NULL OR u < d THEN 'UP' ELSE 'DOWN' END AS touch, CAST(least(coalesce(u, 8), coalesce(d, 8)) AS INT) AS exit_offset, round(ln(c8 / c0) * 10000, 5) AS timeout_bps FROM p""")
def triple_barrier(spark, sf):
    r = ev.forward_touch(src.bars_1d(spark, sf), DAY, 8, 300, 300)
    return rounded(r.select("symbol", "open_time_ms", "touch", "exit_offset", "timeout_bps"), 5, "timeout_bps")


@query(f"""WITH {BARS_1H}, x AS (SELECT *, lead(open_time_ms) OVER w AS n1, lead(open) OVER w AS o1, lead(close_time_ms, 3) OVER w AS t3, lead(close, 3) OVER w AS c3, lead(close_time_ms, 6) OVER w AS t6, lead(close, 6) OVER w AS c6, lead(close_time_ms, 12) OVER w AS t12, lead(close, 12) OVER w AS c12 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time_ms)),
y AS (SELECT *, CASE WHEN n1 = open_time_ms + 3600000 THEN o1 END AS entry FROM x)
SELECT symbol, open_time_ms, round(CASE WHEN t3 = close_time_ms + 3 * 3600000 THEN ln(c3 / entry) * 10000 END, 5) AS ret_3, round(CASE WHEN t6 = close_time_ms + 6 * 3600000 THEN ln(c6 / entry) * 10000 END, 5) AS ret_6, round(CASE WHEN t12 = close_time_ms + 12 * 3600000 THEN ln(c12 / entry) * 10000 END, 5) AS ret_12 FROM y WHERE close > open""")
def time_exits(spark, sf):
    bars = src.bars_1h(spark, sf)
    return rounded(ev.time_exits(bars.where("close > open"), bars, HOUR), 5, "ret_3", "ret_6", "ret_12")


@query()
def non_overlapping_trades(spark, sf):
    return sm.non_overlapping(trades_1d(spark, sf), DAY)


@query(f"""WITH RECURSIVE {TRADES}, o AS (SELECT *, event_ms + held * {DAY} AS until, row_number() OVER (ORDER BY event_ms, symbol) AS k FROM trades WHERE net_bps IS NOT NULL),
-- the open places after each trade, and whether it was taken
f AS (SELECT 0::BIGINT AS k, []::STRUCT(s VARCHAR, t BIGINT)[] AS places, FALSE AS ok UNION ALL SELECT k, CASE WHEN ok THEN list_append(kept, {{'s': symbol, 't': until}}) ELSE kept END, ok FROM (
  SELECT k, symbol, until, kept, len(kept) < 2 AND len(list_filter(kept, lambda p: p.s = symbol)) = 0 AS ok FROM (SELECT o.k, o.symbol, o.until, list_filter(f.places, lambda p: p.t > o.event_ms) AS kept FROM f JOIN o ON o.k = f.k + 1)))
SELECT o.* EXCLUDE (k, until), 2 AS variant FROM o JOIN f USING (k) WHERE ok""")
def capacity_two_trades(spark, sf):
    return sm.capacity_limited(trades_1d(spark, sf), DAY, 2)


@query("""WITH u AS (SELECT s_suppkey, s_acctbal AS volume, n_name AS grp, s_suppkey % 400 AS age FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal >= 1000 AND s_suppkey % 400 >= 14),
newest AS (SELECT s_suppkey FROM u WHERE age <= 365 ORDER BY age, volume DESC, s_suppkey LIMIT 10),
liquid AS (SELECT s_suppkey FROM u WHERE s_suppkey NOT IN (SELECT s_suppkey FROM newest) ORDER BY volume DESC, s_suppkey LIMIT 30)
SELECT s_suppkey, 'new' AS why FROM newest UNION ALL SELECT s_suppkey, 'liquid' FROM liquid""")
def universe_selection(spark, sf):
    """A quarter of the newest, then the most liquid of the rest."""
    s, n = src.read(spark, sf, "supplier"), src.read(spark, sf, "nation")
    u = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", F.col("s_acctbal").alias("volume"), (F.col("s_suppkey") % 400).alias("age")).where("volume >= 1000 and age >= 14")
    newest = u.where("age <= 365").orderBy("age", F.desc("volume"), "s_suppkey").limit(10)
    liquid = u.join(newest.select("s_suppkey"), "s_suppkey", "left_anti").orderBy(F.desc("volume"), "s_suppkey").limit(30)
    return newest.select("s_suppkey", F.lit("new").alias("why")).unionByName(liquid.select("s_suppkey", F.lit("liquid").alias("why")))


from candela.plans import alerts, audits, desk, files, ledgers, market, models, outcomes, selectors, streams, studies  # noqa: E402,F401  (add their queries)
