"""Registered coverage, scenario, provenance, table-function and time-slice queries with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.slices import in_slices
from candela.operators import desk as dk
from candela.operators import market as mk
from candela.operators import studies
from candela.plans.catalog import BARS_1D, BARS_1H, DAY, HOUR, W, query, rounded
from candela.plans.ledgers import LEDGER
from candela.plans.market import calm
from candela.plans.models import FEAT, SCORED, scored
from candela.sources import bars as src
from candela.sources import files as fs
from candela.sources.ledger import signals

#: Open interest of the hourly series: some rows missing, some a second beside the grid, some not positive.
OI = BARS_1H + f""", oi AS MATERIALIZED (SELECT symbol AS series, open_time_ms + CASE WHEN trade_count % 7 = 0 THEN 1000 ELSE 0 END AS t, CASE WHEN trade_count % 13 = 0 THEN 0.0 ELSE volume * 1000 END AS v FROM bars WHERE trade_count % 11 <> 0),
grid AS MATERIALIZED (SELECT *, t - lag(t) OVER (PARTITION BY series ORDER BY t) AS d, count(*) FILTER (v > 0) OVER (PARTITION BY series ORDER BY t RANGE BETWEEN {2 * HOUR} PRECEDING AND CURRENT ROW) AS n FROM oi WHERE t % {HOUR} = 0),
tot AS (SELECT series, lag, count(*) AS rows, count(*) FILTER (t % {HOUR} <> 0) AS off_grid, count(*) FILTER (NOT v > 0) AS invalid, min(t) AS start_ms, max(t) AS end_ms FROM oi, (VALUES (1), (2), (3)) l(lag) GROUP BY ALL),
gg AS (SELECT series, count(*) AS grid_rows, count(*) FILTER (d <> {HOUR}) AS gaps, max(d) AS largest_ms FROM grid GROUP BY series),
ask AS (SELECT b.symbol AS series, b.close_time_ms + 1 AS close_ms, t.lag, g.n = 3 AS done FROM bars b JOIN tot t ON t.series = b.symbol AND b.close_time_ms + 1 BETWEEN start_ms + {2 * HOUR} + lag * {HOUR} AND end_ms + lag * {HOUR} LEFT JOIN grid g ON g.series = b.symbol AND g.t = b.close_time_ms + 1 - lag * {HOUR})"""


@query(f"""WITH {OI}, c AS (SELECT series, lag, count(*) AS eligible, count(*) FILTER (coalesce(done, FALSE)) AS complete, count(*) FILTER (NOT coalesce(done, FALSE)) AS missing, count(DISTINCT CASE WHEN done THEN close_ms // {DAY} END) AS days FROM ask GROUP BY ALL)
SELECT tot.*, grid_rows, gaps, largest_ms, coalesce(eligible, 0) AS eligible, coalesce(complete, 0) AS complete, coalesce(missing, 0) AS missing, coalesce(days, 0) AS days FROM tot JOIN gg USING (series) LEFT JOIN c USING (series, lag)""")
def oi_coverage(spark, sf):
    """Open-interest coverage of hourly candles by assumed lag, with windows of three points."""
    b = src.bars_1h(spark, sf)
    n = F.col("trade_count")
    oi = b.where(n % 11 != 0).select(F.col("symbol").alias("series"), (F.col("open_time_ms") + F.when(n % 7 == 0, 1000).otherwise(0)).alias("t"), F.when(n % 13 == 0, 0.0).otherwise(F.col("volume") * 1000).alias("v"))
    return dk.oi_coverage(oi, b.select(F.col("symbol").alias("series"), (F.col("close_time_ms") + 1).alias("close_ms")), HOUR, points=3)


P_EDGES = (0.42, 0.48, 0.52, 0.58)
_PBIN = " + ".join(f"CAST(p >= {e} AS INT)" for e in P_EDGES)


@query(f"""WITH RECURSIVE {SCORED}, e AS (SELECT quantile_cont(barrier_bps, 1.0 / 3) AS a, quantile_cont(barrier_bps, 2.0 / 3) AS b FROM sc WHERE open_time_ms < 850000000000),
x AS MATERIALIZED (SELECT sc.*, {_PBIN} AS pb, CAST(barrier_bps >= a AS INT) + CAST(barrier_bps >= b AS INT) AS vb, timeout_bps / barrier_bps AS ret, touch IN ('UP', 'BOTH') AS u, touch IN ('DOWN', 'BOTH') AS d FROM sc, e),
cells AS MATERIALIZED (SELECT bit_count(grouping(pb, vb))::INT AS level, pb, vb, count(*) AS n, quantile_cont(ret, 0.1) AS p10, quantile_cont(ret, 0.5) AS p50, quantile_cont(ret, 0.9) AS p90, avg(CAST(u AS INT)) AS touch_up, avg(CAST(d AS INT)) AS touch_down, avg(CAST(u AND d AS INT)) AS touch_both, avg(CAST(NOT u AND NOT d AS INT)) AS touch_neither
  FROM x WHERE open_time_ms < 850000000000 GROUP BY GROUPING SETS ((pb, vb), (pb), ()))
SELECT x.symbol, x.open_time_ms, c.level, c.n, round(c.p10, 6) AS p10, round(c.p50, 6) AS p50, round(c.p90, 6) AS p90, round(c.touch_up, 8) AS touch_up, round(c.touch_down, 8) AS touch_down, round(c.touch_both, 8) AS touch_both, round(c.touch_neither, 8) AS touch_neither
FROM x JOIN cells c ON (c.level = 2 OR c.n >= 60) AND (c.level = 2 OR c.pb = x.pb) AND (c.level > 0 OR c.vb = x.vb) QUALIFY row_number() OVER (PARTITION BY x.symbol, x.open_time_ms ORDER BY c.level) = 1""")
def scenario_lookup(spark, sf):
    """Every row's scenario from the cells of the early rows: by probability and volatility, by probability, or overall."""
    r = scored(spark, sf).withColumn("ret", F.col("timeout_bps") / F.col("barrier_bps"))
    early = F.col("open_time_ms") < 850_000_000_000
    a, b = r.where(early).agg(F.percentile("barrier_bps", F.lit(1) / 3), F.percentile("barrier_bps", F.lit(2) / 3)).first()
    p = sum((F.col("p") >= e).cast("int") for e in P_EDGES)
    v = (F.col("barrier_bps") >= a).cast("int") + (F.col("barrier_bps") >= b).cast("int")
    cells = studies.scenario_cells(r.where(early), p, v, "ret", F.col("touch").isin("UP", "BOTH"), F.col("touch").isin("DOWN", "BOTH"))
    out = studies.scenario_lookup(r.select("symbol", "open_time_ms", "p", "barrier_bps"), cells, p, v, 60).drop("p", "barrier_bps")
    return rounded(rounded(out, 6, "p10", "p50", "p90"), 8, "touch_up", "touch_down", "touch_both", "touch_neither")


@query(f"""WITH {LEDGER} SELECT id, level, round((1000 + id % 977) * (1 + CASE direction WHEN 'LONG' THEN level ELSE -level END / 100), 6) AS target FROM ledger, (VALUES (2.0::DOUBLE), (3.0::DOUBLE), (5.0::DOUBLE)) l(level)""")
def level_ladder(spark, sf):
    """The target prices of every signal by a lateral join with a Python table function."""
    name = dk.register_levels(spark)
    rows = signals(spark, sf).select("id", (1000.0 + F.col("id") % 977).alias("price"), "direction")
    return rounded(spark.sql(f"SELECT id, level, target FROM {{rows}} r, LATERAL {name}(r.price, r.direction)", rows=rows), 6, "target")


_FILES = BARS_1D + f""", f AS (SELECT symbol, open_time_ms // {365 * DAY} AS year, open_time_ms, trade_count FROM bars),
g AS (SELECT *, sum(gap) OVER (PARTITION BY symbol, year ORDER BY open_time_ms) AS segment FROM (SELECT *, CASE WHEN open_time_ms - lag(open_time_ms) OVER (PARTITION BY symbol, year ORDER BY open_time_ms) <> {DAY} THEN 1 ELSE 0 END AS gap FROM f)),
s AS (SELECT symbol, year, segment, count(*) AS n, min(open_time_ms) AS a, max(open_time_ms) AS b FROM g GROUP BY ALL),
b AS (SELECT symbol, year, count(*) AS segments, max(n) AS longest, arg_max(a, {{'n': n, 'z': -a}}) AS start_ms, arg_max(b, {{'n': n, 'z': -a}}) AS end_ms FROM s GROUP BY ALL),
h AS (SELECT symbol, year, count(*) AS rows, 'open_time_ms,trade_count' || chr(10) || string_agg(open_time_ms || ',' || trade_count || chr(10), '' ORDER BY open_time_ms) AS text FROM f GROUP BY ALL)"""


@query(f"""WITH {_FILES} SELECT symbol, year, rows, 0 AS invalid, 0 AS twice, segments, longest, start_ms, end_ms, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY longest DESC, year) = 1 THEN 'SELECTED' ELSE 'AVAILABLE' END AS status, strlen(text) AS bytes, sha256(text) AS sha256 FROM h JOIN b USING (symbol, year)""")
def file_manifest(spark, sf):
    """Candle files of each symbol and year: content hash, segments, and the one with the longest gap-free run."""
    b = src.bars_1d(spark, sf).select("symbol", F.floor(F.col("open_time_ms") / (365 * DAY)).alias("year"), "open_time_ms", "trade_count")
    path = fs.scratch(spark, "candle-files")
    b.repartition("symbol", "year").sortWithinPartitions("symbol", "year", "open_time_ms").write.option("header", True).partitionBy("symbol", "year").csv(path)
    m = fs.file_manifest(spark, path, DAY, "open_time_ms long, trade_count long")
    return m.withColumn("year", F.regexp_extract("file", "year=([^/]+)", 1).cast("long")).drop("file")


@query(f"WITH RECURSIVE {FEAT} SELECT symbol, open_time_ms, round(atr, 6) AS atr, {', '.join(f'round({c}, 5) AS {c}' for c in mk.FEATURES)} FROM feat")
def sliced_features(spark, sf):
    """The nine features with every series cut into slices of 700 rows, each led by the 850 rows that its means remember."""
    r = in_slices(calm(spark, sf), lambda b: mk.feature_frame(b).select("symbol", "open_time_ms", "atr", *mk.FEATURES), before=850, size=700)
    return rounded(rounded(r, 6, "atr"), 5, *mk.FEATURES)


@query(f"""WITH {BARS_1D} SELECT symbol, open_time_ms, max(high) OVER (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS top, min(low) OVER (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead, lag(close, 12) OVER {W} AS old, round(median(quote_volume) OVER (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 6) AS med FROM bars""")
def sliced_windows(spark, sf):
    """Extremes before and after, a lag and a rolling median in slices of 100 rows with 24 rows before and 5 after."""
    from candela.functions.scalars import frame, series

    def f(b):
        w = series()
        return b.select("symbol", "open_time_ms", F.max("high").over(frame(w, 12, -1)).alias("top"), F.min("low").over(w.rowsBetween(1, 5)).alias("ahead"), F.lag("close", 12).over(w).alias("old"), F.round(F.percentile("quote_volume", 0.5).over(frame(w, 24, -1)), 6).alias("med"))

    return in_slices(src.bars_1d(spark, sf), f, before=24, after=5, size=100)
