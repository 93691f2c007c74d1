"""Registered source and sink queries: tables are written, read back and compared by SQL over the inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import ledgers as lg
from candela.plans.catalog import BARS_1D, BARS_1H, DAY, HOUR, query, rounded
from candela.plans.ledgers import EXEC, LEDGER
from candela.sources import bars as src
from candela.sources import files as fs
from candela.sources.ledger import signals

W = "(PARTITION BY symbol ORDER BY open_time_ms)"


@query(f"""WITH {BARS_1D}, g AS (SELECT *, coalesce(open_time_ms - lag(open_time_ms) OVER {W} <> {DAY}, FALSE) AS gap FROM bars), q AS (SELECT symbol FROM g GROUP BY symbol HAVING count(*) >= 300 AND count(*) FILTER (gap) <= count(*) * 0.6)
SELECT symbol, count(*) AS n, round(sum(close), 4) AS closes, sum(trade_count)::BIGINT AS trades FROM bars WHERE symbol IN (SELECT symbol FROM q) GROUP BY symbol""")
def candle_csv(spark, sf):
    """Candles written as CSV by symbol, read in one scan, series of good quality kept."""
    path = fs.scratch(spark, "csv")
    fs.write_candle_csv(src.bars_1d(spark, sf), path)
    r = fs.with_quality(fs.read_candle_csv(spark, path), DAY, 300, 0.6)
    return rounded(r.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("close").alias("closes"), F.sum("trade_count").alias("trades")), 4, "closes")


@query(f"WITH {BARS_1D} SELECT symbol, open, high, low, close, close_time_ms FROM bars")
def candle_array_json(spark, sf):
    """Candles through gzip JSON arrays and back."""
    path = fs.scratch(spark, "json")
    fs.write_array_json(src.bars_1d(spark, sf), path, 90 * DAY)
    return fs.read_array_json(spark, path)


@query(f"WITH {LEDGER} SELECT id, symbol, settled_ms, net FROM ledger WHERE id % 10 <> 0 AND id % 7 <> 0 ORDER BY settled_ms DESC, id LIMIT 500")
def ledger_scan(spark, sf):
    """The newest 500 rows of a JSON-line ledger with broken lines and rows of another schema."""
    path = fs.scratch(spark, "ledger")
    whole = F.to_json(F.struct(F.when(F.col("id") % 7 == 0, "v1").otherwise("v2").alias("schema"), "id", "symbol", "settled_ms", "net"))
    signals(spark, sf).select(F.when(F.col("id") % 10 == 0, F.substring(whole, F.lit(1), F.length(whole) - 5)).otherwise(whole).alias("value")).write.text(path)
    return fs.read_ledger(spark, path, "id long, symbol string, settled_ms long, net double", "v2", 500)


@query(f"""WITH {LEDGER}, r AS (SELECT CASE WHEN score < 0.5 THEN 'score' WHEN net IS NULL THEN 'net' WHEN status IS NULL THEN 'status' END AS reason FROM ledger) SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM r GROUP BY ALL""")
def quarantine(spark, sf):
    """Pending records split into valid ones and a quarantine table with the first broken rule."""
    path = fs.scratch(spark, "quarantine")
    good = fs.split_valid(signals(spark, sf), {"score": F.col("score") >= 0.5, "net": F.col("net").isNotNull(), "status": F.col("status").isNotNull()}, path)
    return good.select(F.lit("valid").alias("reason")).unionByName(spark.read.parquet(path).select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {LEDGER}, r AS (SELECT id, symbol, CASE WHEN id % 29 = 0 THEN 'json' WHEN coalesce(score < 0.5, TRUE) THEN 'score' WHEN net IS NULL THEN 'net' END AS problem FROM ledger) SELECT symbol, coalesce(problem, 'valid') AS problem, count(*) AS n FROM r GROUP BY ALL""")
def pending_records(spark, sf):
    """Pending records from folders of JSON files, some cut off: valid ones, and the others with their file and what is wrong."""
    path = fs.scratch(spark, "pending")
    whole = F.to_json(F.struct("id", "score", "net", "symbol"))
    signals(spark, sf).select("symbol", F.when(F.col("id") % 29 == 0, F.substring(whole, F.lit(1), F.length(whole) - 6)).otherwise(whole).alias("value")).write.partitionBy("symbol").text(path)
    good, bad = fs.read_pending(spark, path, "id long, score double, net double, symbol string", {"score": F.col("score") >= 0.5, "net": F.col("net").isNotNull()})
    of_file = bad.select(F.regexp_extract("file", "symbol=([^/]+)", 1).alias("symbol"), "problem")
    return good.select("symbol", F.lit("valid").alias("problem")).unionByName(of_file).groupBy("symbol", "problem").agg(F.count("*").alias("n"))


@query(f"""WITH {BARS_1H}, r AS (SELECT CASE WHEN trade_count % 6 = 0 THEN 'payload' END AS problem, close_time_ms, close FROM bars) SELECT problem, count(*) AS n, round(sum(CASE WHEN problem IS NULL THEN close END), 4) AS closes FROM r WHERE problem IS NOT NULL OR close_time_ms < 1706000000000 GROUP BY problem""")
def payload_rows(spark, sf):
    """Exchange payload arrays to typed candles: bad rows are marked, open candles go."""
    cols = ["open_time_ms", "open", "high", "low", "close", "volume", "close_time_ms", "quote_volume", "trade_count", "taker_buy_base"]
    text = [F.when((F.col("trade_count") % 6 == 0) & F.lit(c == "high"), "n/a").otherwise(F.col(c).cast("string")) for c in cols]
    r = fs.parse_payload(src.bars_1h(spark, sf).select("symbol", F.to_json(F.array(*text)).alias("payload")), 1_706_000_000_000)
    return rounded(r.groupBy("problem").agg(F.count("*").alias("n"), F.sum(F.when(F.col("problem").isNull(), F.col("close"))).alias("closes")), 4, "closes")


OI = "oi AS (SELECT epoch_ms(o_orderdate) AS t, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1)"


@query(f"WITH {OI}, old AS (SELECT * FROM oi WHERE t % {3 * DAY} <> 0), new AS (SELECT t, v * 2 AS v FROM oi WHERE t % {2 * DAY} = 0), k AS (SELECT coalesce(new.t, old.t) AS t, coalesce(new.v, old.v) AS v FROM old FULL JOIN new USING (t)) SELECT count(*) - (SELECT count(*) FROM old) AS added, count(*) AS n, round((max(t) - min(t)) / {float(DAY)}, 6) AS days, sum(v) AS total FROM k")
def open_interest_append(spark, sf):
    """Open interest appended to a table on disk, newest value of each time; rows added and days covered."""
    oi = src.read(spark, sf, "orders").groupBy(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("t")).agg(F.count("*").cast("double").alias("v"))
    path = fs.scratch(spark, "oi")
    oi.where(F.col("t") % (3 * DAY) != 0).write.parquet(path)
    added = fs.append_keep_last(spark, path, oi.where(F.col("t") % (2 * DAY) == 0).withColumn("v", F.col("v") * 2), ("t",), "v")
    r = spark.read.parquet(path)
    return rounded(r.agg(F.lit(added).cast("long").alias("added"), F.count("*").alias("n"), ((F.max("t") - F.min("t")) / DAY).alias("days"), F.sum("v").alias("total")), 6, "days")


@query(f"""WITH {BARS_1D}, m AS (SELECT * REPLACE (CASE WHEN open_time_ms % {5 * DAY} = 0 THEN close * 1 ELSE close END AS close) FROM bars WHERE open_time_ms >= 990000000000 - {400 * DAY}), v AS (SELECT *, CASE WHEN open_time_ms - lag(open_time_ms) OVER {W} <> {DAY} THEN open_time_ms END AS gap FROM m), t AS (SELECT *, max(gap) OVER (PARTITION BY symbol) AS lg FROM v)
SELECT symbol, count(*) AS n, min(open_time_ms) AS first_ms, max(open_time_ms) AS last_ms FROM t WHERE (lg IS NULL OR open_time_ms >= lg) GROUP BY symbol""")
def candle_retention(spark, sf):
    """The candle sink: merge, validate, retain, trim to the contiguous tail, overwrite partitions, read back."""
    bars = src.bars_1d(spark, sf)
    path = fs.scratch(spark, "sink")
    bars.where("open_time_ms < 960000000000").write.partitionBy("symbol").parquet(path)
    r = fs.retain(spark, path, bars.where(f"open_time_ms >= 960000000000 - {30 * DAY}"), DAY, 990_000_000_000, 400)
    return r.groupBy("symbol").agg(F.count("*").alias("n"), F.min("open_time_ms").alias("first_ms"), F.max("open_time_ms").alias("last_ms"))


@query(f"WITH {LEDGER} SELECT count(*) AS n, count(DISTINCT id) AS ids, sum(horizon)::BIGINT AS horizons FROM ledger WHERE status IS NOT NULL")
def ledger_sink(spark, sf):
    """Settled rows appended three times over to a ledger on disk: every key once."""
    rows = signals(spark, sf).where("status is not null").select("id", "horizon", "status", "net")
    path = fs.scratch(spark, "sink")
    rows.where("id % 3 = 0").write.parquet(path)
    for _ in range(2):
        fs.append_once(spark, path, rows.unionByName(rows.where("id % 2 = 0")), ("id", "horizon"))
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum("horizon").alias("horizons"))


@query(f"WITH {LEDGER}, p AS (SELECT id, CASE WHEN id % 3 <> 0 THEN score ELSE score + 1 END AS score, (id % 3 <> 0 AND id % 5 = 0) OR (id % 2 = 0 AND notified) AS sent FROM ledger WHERE id % 3 <> 0 OR id % 2 = 0) SELECT id, score, sent FROM p WHERE id NOT IN (SELECT id FROM ledger WHERE status IS NOT NULL)")
def pending_merge(spark, sf):
    """Pending records inserted if absent, their sent flag raised only; the open ones are those the ledger lacks."""
    l = signals(spark, sf)
    old = l.where("id % 3 <> 0").select("id", "score", (F.col("id") % 5 == 0).alias("sent"))
    new = l.where("id % 2 = 0").select("id", (F.col("score") + 1).alias("score"), F.col("notified").alias("sent"))
    return fs.merge_pending(old, new, "id", "sent").join(l.where("status is not null").select("id"), "id", "left_anti").select("id", "score", "sent")


@query(f"""WITH {BARS_1D}, g AS (SELECT symbol, min(open_time_ms) AS f, max(close_time_ms) AS l FROM bars WHERE symbol <> 'N' OR open_time_ms > 800000000000 GROUP BY symbol)
SELECT symbol, 'head' AS part, 780000000000 AS from_ms, f AS to_ms FROM g WHERE f > 780000000000 AND symbol <> 'A' UNION ALL SELECT symbol, 'tail', l + 1, 1010000000000 FROM g WHERE l < 1010000000000 - 1""")
def backfill_plan(spark, sf):
    """Head and tail ranges that a longer history lacks; one symbol's head was asked for before."""
    bars = src.bars_1d(spark, sf).where("symbol <> 'N' or open_time_ms > 800000000000")
    covered = bars.where("symbol = 'A'").groupBy("symbol").agg(F.lit(780_000_000_000).alias("covered_ms"))
    return fs.missing_ranges(bars, 780_000_000_000, 1_010_000_000_000, covered)


@query(f"WITH {LEDGER} SELECT strategy, count(*) AS n, round(avg(net), 6) AS mean_net, bool_or(bar_ms > 900000000000) AS fresh FROM ledger GROUP BY strategy HAVING strategy <> 'DIRECTIONAL_SHORT'")
def model_bundles(spark, sf):
    """Model rows saved, read back and checked for version, finite numbers and age."""
    g = signals(spark, sf).groupBy("strategy").agg(F.count("*").alias("n"), F.avg("net").alias("m"), F.max("bar_ms").alias("trained_ms"))
    odd = F.col("strategy") == "DIRECTIONAL_SHORT"
    path = fs.scratch(spark, "models")
    g.select("strategy", "n", F.lit(3).alias("version"), F.col("m").alias("intercept"), F.array(F.col("m"), F.when(odd, float("nan")).otherwise(1.0)).alias("weights"), "trained_ms").write.json(path, ignoreNullFields=False)
    r = fs.checked_models(spark.read.schema("strategy string, n long, version int, intercept double, weights array<double>, trained_ms long").json(path), 3, 1_010_000_000_000, 1273)
    return rounded(r.select("strategy", "n", F.col("intercept").alias("mean_net"), "fresh"), 6, "mean_net")


@query(f"""WITH {EXEC} SELECT to_json({{'id': id, 'symbol': symbol, 'tier': tier, 'families': families}}) AS row FROM exec WHERE tier = 'SETUP'""")
def dashboard_export(spark, sf):
    """Allow-listed columns of each setup as one JSON object."""
    r = lg.execution(signals(spark, sf)).where("tier = 'SETUP'")
    return r.select(F.to_json(F.struct("id", "symbol", "tier", "families")).alias("row"))


@query("WITH l AS (SELECT CASE WHEN user_id % 5 = 0 THEN 'WARN' ELSE 'INFO' END AS level, event_id, user_id FROM events), p AS (SELECT level, 'scanned' AS name, event_id % 100 AS v FROM l UNION ALL SELECT level, 'rejected', user_id FROM l WHERE event_id % 2 = 0) SELECT level, name, count(*) AS lines, sum(v)::BIGINT AS total FROM p GROUP BY ALL")
def log_counters(spark, sf):
    """Counters in a service log, written as text and read by pattern."""
    e = src.read(spark, sf, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("user_id") % 5 == 0, " WARN ").otherwise(" INFO "), F.lit("scan scanned="), (F.col("event_id") % 100).cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" rejected="), F.col("user_id").cast("string"))).otherwise(""))
    path = fs.scratch(spark, "log")
    e.select(line.alias("value")).write.text(path)
    return fs.log_counts(spark.read.text(path))


@query("""WITH r AS (SELECT s_suppkey AS k, upper(trim(CASE WHEN s_suppkey % 3 = 0 THEN ' s' || s_suppkey % 50 || 'usdt ' WHEN s_suppkey % 7 = 0 THEN 'bad-' || s_suppkey ELSE 's' || s_suppkey % 50 END)) AS s FROM supplier), f AS (SELECT k, CASE WHEN s LIKE '%USDT' THEN s ELSE s || 'USDT' END AS symbol FROM r)
SELECT symbol, min(k) AS first_seen FROM f WHERE regexp_full_match(symbol, '[A-Z0-9]{1,20}USDT') GROUP BY symbol""")
def symbol_list(spark, sf):
    """Normalised valid symbols in the order first seen."""
    k = F.col("s_suppkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" s"), (k % 50).cast("string"), F.lit("usdt "))).when(k % 7 == 0, F.concat(F.lit("bad-"), k.cast("string"))).otherwise(F.concat(F.lit("s"), (k % 50).cast("string")))
    return fs.symbols_of(src.read(spark, sf, "supplier").select(raw.alias("raw"), k), "raw", "s_suppkey")


@query("""SELECT p_partkey AS id FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 11 <> 0 AND p_size % 7 <> 1 AND p_partkey % 13 <> 5 AND p_partkey % 17 > 0""")
def contract_filter(spark, sf):
    """Tradable coin perpetuals among contract rows."""
    k = F.col("p_partkey")
    rows = src.read(spark, sf, "part").select(
        k.alias("id"), F.concat(F.lit("C"), (k % 13).cast("string")).alias("symbol"), F.when(k % 10 == 0, "BREAK").otherwise("TRADING").alias("status"), F.lit("PERPETUAL").alias("kind"), F.lit("USDT").alias("quote"),
        F.when(k % 11 == 0, "USDC").otherwise("USDT").alias("margin"), F.lit("COIN").alias("underlying"), F.when(F.col("p_size") % 7 == 1, F.array(F.lit("x"), F.lit("tradfi-stock"))).otherwise(F.array(F.lit("meme"))).alias("subtypes"), (k % 17).alias("onboard_ms"))
    return fs.contracts(rows, excluded=("C5",)).select("id")


@query("""WITH e AS (SELECT n_name AS "group", 'S' || s_suppkey AS spot, CASE WHEN s_suppkey % 20 = 0 THEN 'P' || s_suppkey ELSE 'S' || s_suppkey END AS perpetual FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT "group", count(*) AS n, count(*) FILTER (spot <> perpetual) AS overridden, 0::BIGINT AS problems FROM e GROUP BY ALL""")
def universe_manifest(spark, sf):
    """A manifest's groups exploded, overrides applied, sizes and repeats checked."""
    s = src.read(spark, sf, "supplier").join(src.read(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    name = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    groups = s.groupBy("n_name").agg(F.collect_list(name).alias("symbols")).select(F.struct(F.col("n_name").alias("name"), "symbols", F.array(F.lit("F1")).alias("strategies"), F.size("symbols").alias("expected")).alias("g"))
    swaps = s.where("s_suppkey % 20 = 0").agg(F.map_from_entries(F.collect_list(F.struct(name, F.concat(F.lit("P"), F.col("s_suppkey").cast("string"))))).alias("overrides"))
    path = fs.scratch(spark, "manifest")  # one manifest: its symbol lists are the table's suppliers
    groups.agg(F.collect_list("g").alias("groups")).crossJoin(swaps).write.json(path)
    m = spark.read.schema("groups array<struct<name:string,symbols:array<string>,strategies:array<string>,expected:int>>, overrides map<string,string>").json(path)
    e = fs.manifest_entries(m)
    bad = fs.manifest_problems(e).agg(F.count("*").alias("problems"))
    return e.groupBy("group").agg(F.count("*").alias("n"), F.count_if(F.col("spot") != F.col("perpetual")).alias("overridden")).crossJoin(F.broadcast(bad))


BAD = BARS_1H + f""", d AS (SELECT * REPLACE (CASE trade_count % 9 WHEN 1 THEN 'Infinity'::DOUBLE ELSE high END AS high, CASE trade_count % 9 WHEN 2 THEN NULL WHEN 3 THEN -1.0 ELSE volume END AS volume, CASE trade_count % 9 WHEN 4 THEN 'NaN'::DOUBLE ELSE quote_volume END AS quote_volume, CASE trade_count % 9 WHEN 5 THEN volume * 3 ELSE taker_buy_base END AS taker_buy_base,
  CASE trade_count % 9 WHEN 6 THEN high + 1 ELSE low END AS low, CASE trade_count % 9 WHEN 7 THEN close_time_ms + 1 ELSE close_time_ms END AS close_time_ms, CASE trade_count % 9 WHEN 8 THEN -open ELSE open END AS open) FROM bars)"""


def damaged(spark, sf):
    b, k = src.bars_1h(spark, sf), F.col("trade_count") % 9
    swap = lambda n, new, old: F.when(k == n, new).otherwise(old)
    return b.select("symbol", "open_time_ms", swap(8, -F.col("open"), F.col("open")).alias("open"), swap(1, F.lit(float("inf")), F.col("high")).alias("high"), swap(6, F.col("high") + 1, F.col("low")).alias("low"), "close",
                    F.when(k == 2, None).when(k == 3, -1.0).otherwise(F.col("volume")).alias("volume"), swap(4, F.lit(float("nan")), F.col("quote_volume")).alias("quote_volume"), "trade_count", swap(5, F.col("volume") * 3, F.col("taker_buy_base")).alias("taker_buy_base"),
                    swap(7, F.col("close_time_ms") + 1, F.col("close_time_ms")).alias("close_time_ms"))


@query(f"""WITH {BAD} SELECT symbol, CASE WHEN NOT (isfinite(high) AND volume IS NOT NULL AND isfinite(quote_volume)) THEN 'not finite' WHEN least(open, high, low, close) <= 0 THEN 'price' WHEN volume < 0 THEN 'volume' WHEN taker_buy_base > volume * 1.0001 + 1e-8 THEN 'taker' WHEN high < greatest(open, close, low) THEN 'high' WHEN low > least(open, close, high) THEN 'low' WHEN close_time_ms <> open_time_ms + {HOUR - 1} THEN 'grid' ELSE 'ok' END AS violation, count(*) AS n FROM d GROUP BY ALL""")
def candle_rules(spark, sf):
    """Candles damaged in every way, counted by the first rule they break."""
    return src.validated(damaged(spark, sf), HOUR).groupBy("symbol", F.coalesce("violation", F.lit("ok")).alias("violation")).agg(F.count("*").alias("n"))


@query(f"""WITH {BAD}, g AS (SELECT * FROM d WHERE isfinite(high) AND volume >= 0 AND isfinite(quote_volume) AND open > 0 AND taker_buy_base <= volume * 1.0001 + 1e-8 AND low <= high AND close_time_ms = open_time_ms + {HOUR - 1} AND trade_count % 5 <> 0) SELECT symbol, count(*) AS n, round(sum(close), 4) AS closes FROM g GROUP BY symbol""")
def candle_rows_kept(spark, sf):
    """Good rows only; stamps that come twice are rejected with both their rows."""
    d = damaged(spark, sf)
    twice = d.unionByName(d.where("trade_count % 5 = 0"))
    r = twice.withColumn("twice", src.repeated(twice)).where("not twice").drop("twice")
    return rounded(src.validated(r, HOUR, "drop").groupBy("symbol").agg(F.count("*").alias("n"), F.sum("close").alias("closes")), 4, "closes")


@query(f"""WITH {BARS_1D}, g AS (SELECT *, sum(gap) OVER {W} AS seg FROM (SELECT *, CASE WHEN open_time_ms - lag(open_time_ms) OVER {W} <> {DAY} THEN 1 ELSE 0 END AS gap FROM bars))
SELECT symbol, count(*) AS bars, max(seg)::BIGINT + 1 AS segments, min(open_time_ms) AS start_ms, max(open_time_ms) AS end_ms, count(*) FILTER (taker_buy_base > volume) AS invalid, any_value(hash) AS hash FROM g JOIN (SELECT symbol, sha256(string_agg(h, ',' ORDER BY part)) AS hash FROM (SELECT symbol, open_time_ms // {30 * DAY} AS part, sha256(string_agg(open_time_ms || ':' || trade_count, ',' ORDER BY open_time_ms)) AS h FROM bars GROUP BY ALL) GROUP BY symbol) USING (symbol) GROUP BY symbol""")
def data_manifest(spark, sf):
    """Candles, segments, range, invalid rows and a provenance hash of each source."""
    bars = src.bars_1d(spark, sf)
    row = F.concat_ws(":", F.col("open_time_ms").cast("string"), F.col("trade_count").cast("string"))
    g = src.segments(bars, DAY).groupBy("symbol").agg(F.count("*").alias("bars"), (F.max("segment") + 1).alias("segments"), F.min("open_time_ms").alias("start_ms"), F.max("open_time_ms").alias("end_ms"), F.count_if(F.col("taker_buy_base") > F.col("volume")).alias("invalid"))
    return g.join(fs.series_hash(bars, row, 30 * DAY), "symbol")


@query(f"""WITH {LEDGER}, t AS (SELECT strategy, count(*) AS trades, round(avg(net), 6) AS mean_net FROM ledger GROUP BY strategy) SELECT *, trades >= 100 AND mean_net > 0 AS passed FROM t""")
def study_outputs(spark, sf):
    """Trades as CSV, metrics and gates as JSON, read back."""
    l = signals(spark, sf).select("id", "strategy", "net")
    path = fs.scratch(spark, "study")
    l.write.option("header", True).csv(path + "/trades")
    back = spark.read.schema("id long, strategy string, net double").option("header", True).csv(path + "/trades")
    back.groupBy("strategy").agg(F.count("*").alias("trades"), F.round(F.avg("net"), 6).alias("mean_net")).withColumn("gates", F.struct((F.col("trades") >= 100).alias("enough"), (F.col("mean_net") > 0).alias("positive"))).write.json(path + "/metrics")
    m = spark.read.schema("strategy string, trades long, mean_net double, gates struct<enough:boolean,positive:boolean>").json(path + "/metrics")
    return m.select("strategy", "trades", "mean_net", (F.col("gates.enough") & F.col("gates.positive")).alias("passed"))
