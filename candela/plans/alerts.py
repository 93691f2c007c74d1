"""Registered universe, alert, record and pivot queries with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import ledgers as lg
from candela.plans.catalog import DAY, HOUR, query, rounded
from candela.plans.ledgers import LEDGER, NOW, _wilson
from candela.sources import bars as src
from candela.sources.ledger import signals

_U = f"""u AS (SELECT 'S' || s_suppkey AS symbol, s_suppkey % 400 AS age, s_acctbal AS volume FROM supplier WHERE s_acctbal >= 500 AND s_suppkey % 400 >= 14 AND abs(s_suppkey % 41 - 20) <= 15 AND (s_suppkey % 23) / 2.0 - 1 BETWEEN 0 AND 8),
n AS (SELECT symbol FROM u WHERE age <= 365 ORDER BY age, volume DESC, symbol LIMIT 10),
r AS (SELECT u.*, u.symbol IN (SELECT symbol FROM n) AS first FROM u)"""


@query(f"""WITH {_U} SELECT 0 AS cap, symbol, row_number() OVER (ORDER BY volume DESC, symbol)::INT AS place FROM u UNION ALL
SELECT 40, symbol, place FROM (SELECT symbol, row_number() OVER (ORDER BY NOT first, CASE WHEN first THEN age END, volume DESC, symbol)::INT AS place FROM r) WHERE place <= 40""")
def universe_quality(spark, sf):
    """Markets that pass age, volume, funding and spread: all of them, and a capped choice with a quarter of the newest."""
    k = F.col("s_suppkey")
    s = src.read(spark, sf, "supplier").withColumn("symbol", F.concat(F.lit("S"), k.cast("string")))
    contracts = s.select("symbol", (F.lit(NOW) - (k % 400) * F.lit(DAY).cast("long")).alias("onboard_ms"))
    snaps = s.select("symbol", F.col("s_acctbal").alias("quote_volume"), (k % 41 - 20).cast("double").alias("funding_bps"), ((k % 23) / 2.0 - 1).alias("spread_bps"))
    out = [lg.universe(contracts, snaps, NOW, 500, 15, 8, cap).select(F.lit(cap).alias("cap"), "symbol", "place") for cap in (0, 40)]
    return out[0].unionByName(out[1])


_Q = 900_000


@query(f"""WITH {LEDGER}, runs AS (SELECT *, now_ms - now_ms // {_Q} % 5 * {_Q} AS scanned_ms, now_ms - {2 * HOUR} AS started_ms, now_ms // {DAY} % 3 <> 0 AS bull, now_ms // {_Q} % 7 <> 0 AS healthy FROM (SELECT DISTINCT bar_ms // {_Q} * {_Q} + {_Q} AS now_ms FROM ledger)),
rec AS (SELECT id, symbol, score, bar_ms + 60000 AS recorded_ms, bar_ms AS source_ms FROM ledger WHERE id % 4 <> 0 AND family IN ('F1', 'F2') AND score >= 1),
got AS (SELECT id, symbol, bar_ms + 120000 AS delivered_ms FROM ledger WHERE notified AND id % 5 = 0),
may AS (SELECT now_ms, rec.* FROM runs JOIN rec ON recorded_ms BETWEEN now_ms - {_Q} AND now_ms AND source_ms BETWEEN now_ms - {_Q} AND now_ms AND recorded_ms >= started_ms WHERE bull AND healthy AND now_ms - scanned_ms BETWEEN 0 AND {HOUR - 1}),
ok AS (SELECT * FROM may WHERE NOT EXISTS (SELECT 1 FROM got WHERE got.symbol = may.symbol AND delivered_ms <= now_ms AND (got.id = may.id OR now_ms - delivered_ms < {10 * DAY})))
SELECT now_ms, id FROM ok QUALIFY row_number() OVER (PARTITION BY now_ms, symbol ORDER BY recorded_ms, score DESC, id) = 1""")
def owner_alerts(spark, sf):
    """What every run of the ledger's quarter hours may send to the owner."""
    l = signals(spark, sf)
    now = F.col("now_ms")
    quarter = F.floor(now / _Q)
    runs = l.select((F.floor(F.col("bar_ms") / _Q) * _Q + _Q).alias("now_ms")).distinct().select("now_ms", (now - 2 * HOUR).alias("started_ms"), (now - quarter % 5 * _Q).alias("scanned_ms"), F.when(F.floor(now / DAY) % 3 != 0, "BULL_CONFIRMED").otherwise("OFF").alias("regime"), (quarter % 7 != 0).alias("healthy"))
    rec = l.select("id", "symbol", F.when(F.col("family") == "F1", "LB1").when(F.col("family") == "F2", "LP1").otherwise("LA1").alias("strategy"), F.when(F.col("id") % 4 != 0, "CONFIRMED").otherwise("WATCH").alias("stage"), "score", (F.col("bar_ms") + 60_000).alias("recorded_ms"), F.col("bar_ms").alias("source_ms"))
    got = l.where("notified and id % 5 = 0").select("id", "symbol", (F.col("bar_ms") + 120_000).alias("delivered_ms"))
    return lg.owner_alerts(rec, got, runs, 1.0, spacing_ms=10 * DAY)


@query(f"""WITH RECURSIVE {LEDGER}, r AS (SELECT id, bar_ms // {DAY} * {DAY} AS t, symbol || '|' || strategy AS key, row_number() OVER (PARTITION BY bar_ms // {DAY} ORDER BY id % 2 = 0 DESC, score DESC, symbol, id) AS place FROM ledger),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY t, place) AS k FROM r WHERE place <= 4),
f AS (SELECT 0::BIGINT AS k, CAST(NULL AS BIGINT) AS id, []::STRUCT(s VARCHAR, t BIGINT)[] AS last, []::BIGINT[] AS ends, FALSE AS ok
  UNION ALL SELECT k, id, CASE WHEN ok THEN list_append(kept, {{'s': key, 't': t}}) ELSE kept END, CASE WHEN ok THEN list_append(live, t + {7 * DAY}) ELSE live END, ok FROM (
  SELECT *, len(live) < 20 AND len(list_filter(kept, lambda p: p.s = key)) = 0 AS ok FROM (SELECT o.k, o.id, o.key, o.t, list_filter(f.last, lambda p: o.t - p.t < {20 * DAY}) AS kept, list_filter(f.ends, lambda e: e > o.t) AS live FROM f JOIN o ON o.k = f.k + 1)))
SELECT 'p' AS profile, id FROM f WHERE ok""")
def long_records(spark, sf):
    """Daily scans: the four best of each, twenty days between records of a symbol and strategy, at most twenty held for a week."""
    rows = signals(spark, sf).select(F.lit("p").alias("profile"), "id", (F.floor(F.col("bar_ms") / DAY) * DAY).alias("t"), "symbol", "strategy", (F.col("id") % 2 == 0).alias("confirmed"), "score")
    return lg.long_records(rows, spacing_ms=20 * DAY, per_scan=4)


def _level(k: int) -> str:
    at, n = f"level = {k} AND NOT gone", f"(h{k} + m{k})"
    return f"count(*) FILTER ({at} AND ok) AS h{k}, count(*) FILTER ({at} AND NOT ok) AS m{k}, count(*) FILTER ({at} AND ok IS NULL) AS p{k}, count(*) FILTER (level = {k} AND gone) AS g{k}", \
        f'h{k} AS hits_{k}, m{k} AS misses_{k}, p{k} AS pending_{k}, g{k} AS missing_{k}, round(h{k} / nullif({n}, 0), 8) AS rate_{k}, CASE WHEN {n} > 0 THEN round({_wilson(f"h{k}", n, "-")}, 8) END AS low_{k}, CASE WHEN {n} > 0 THEN round({_wilson(f"h{k}", n, "+")}, 8) END AS high_{k}'


@query(f"""WITH {LEDGER}, x AS (SELECT *, id % 19 = 0 AS gone, CASE WHEN status IS NOT NULL THEN gross >= level * 50 END AS ok, coalesce(direction, 'UNKNOWN') || ' ' || array_to_string(families, '+') AS setup FROM ledger, (VALUES (2), (3), (5)) v(level)
  WHERE notified AND CAST(timezone('Europe/Istanbul', make_timestamptz(bar_ms * 1000)) AS DATE) BETWEEN DATE '1994-03-01' AND DATE '1998-02-28'),
g AS (SELECT strategy, regime, setup, {', '.join(_level(k)[0] for k in (2, 3, 5))}, count(DISTINCT id) AS signals FROM x GROUP BY ALL)
SELECT strategy, regime, setup, {', '.join(_level(k)[1] for k in (2, 3, 5))}, signals FROM g""")
def target_pivot(spark, sf):
    """The dashboard's target table over local dates: hits, misses, pending and missing with Wilson bounds by level."""
    l = signals(spark, sf).withColumn("level", F.explode(F.array(*[F.lit(k) for k in (2, 3, 5, 10)])))
    t = l.select("id", "strategy", "regime", "direction", "families", "notified", F.col("bar_ms").alias("source_ms"), "level", F.when(F.col("id") % 19 == 0, "DATA_MISSING").otherwise(F.col("status")).alias("status"), F.when(F.col("status").isNotNull(), F.col("gross") >= F.col("level") * 50).alias("success"))
    r = lg.target_pivot(t, NOW, "notified", since="1994-03-01", until="1998-02-28")
    return rounded(r, 8, *[f"{c}_{k}" for k in (2, 3, 5) for c in ("rate", "low", "high")])
