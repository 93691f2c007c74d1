"""Study tables over features and settled trades: folds, calibration, scenarios, stress, gates, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.scalars import ratio, series

DAY = 86_400_000


def walk_forward(rows: DataFrame, embargo: int, least_train: int = 500, least: int = 120, least_test: int = 60) -> DataFrame:
    """(symbol, fold, role, rows, first_ms, last_ms): training on all rows before, calibration, test, with an
    embargo between them. Folds come from the row count; rows meet only the folds of their own symbol."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    r = rows.select("symbol", "open_time_ms", (F.row_number().over(series()) - 1).alias("i"), n.alias("n"))
    e = F.greatest(F.lit(least_train), F.floor(F.col("n") / 2)).cast("long")
    size = F.greatest(F.lit(least), F.floor(F.col("n") / 10)).cast("long")
    r = r.withColumns({"e": e, "size": size}).withColumn("folds", F.floor((F.col("n") - least_test - F.col("e") - F.col("size") - 2 * embargo) / F.col("size")) + 1)
    r = r.where("folds > 0").withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.col("folds") - 1)))
    train = F.col("e") + F.col("fold") * F.col("size")
    cal, test = train + embargo, train + F.col("size") + 2 * embargo
    i = F.col("i")
    role = F.when(i < train, "train").when((i >= cal) & (i < cal + F.col("size")), "calibration").when((i >= test) & (i < test + F.col("size")), "test")
    return r.withColumn("role", role).where("role is not null").groupBy("symbol", "fold", "role").agg(
        F.count("*").alias("rows"), F.min("open_time_ms").alias("first_ms"), F.max("open_time_ms").alias("last_ms"))


def standardised(rows: DataFrame, cols: tuple[str, ...], key: str = "symbol", clip: float = 8.0, floor: float = 1e-9) -> DataFrame:
    """Each column less its mean over the key, in population deviations, clipped. One small row for each key is joined back."""
    stats = rows.groupBy(key).agg(*[f(c).alias(f"_{k}_{c}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = {c: F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_s_{c}"), F.lit(floor)))) for c in cols}
    return rows.join(stats, key).withColumns(z).select(*rows.columns)


def calibration_bins(rows: DataFrame, p: Column, hit: Column, edges: tuple[float, ...] = (0.4, 0.6, 0.8)) -> DataFrame:
    """Predicted and observed share in each bin of the prediction, by symbol."""
    b = F.lit(0)
    for e in edges:
        b = b + (F.col("p") >= e).cast("int")
    r = rows.select("symbol", p.alias("p"), hit.cast("int").alias("hit")).where("p is not null and hit is not null")
    return r.groupBy("symbol", b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 8).alias("predicted"), F.round(F.avg("hit"), 8).alias("observed"))


def cost_stress(trades: DataFrame, costs: tuple[float, ...] = (12, 30, 50, 70)) -> DataFrame:
    """The same trades at several costs, with promotion gates. Costs multiply aggregated inputs, not the joins."""
    r = trades.where("gross_bps is not null").withColumn("cost", F.explode(F.array(*[F.lit(float(c)) for c in costs]))).withColumn("net", F.col("gross_bps") - F.col("cost"))
    g = r.groupBy("cost").agg(F.count("*").alias("trades"), F.count_distinct("symbol").alias("symbols"), F.count_distinct(F.floor(F.col("event_ms") / DAY)).alias("days"), F.round(F.avg("net"), 6).alias("mean_net"), F.count_if(F.col("net") > 0).alias("wins"))
    return g.withColumn("gate", (F.col("trades") >= 100) & (F.col("days") >= 15) & (F.col("symbols") >= 2) & (F.col("mean_net") > 0))


def scenario_table(rows: DataFrame, value: str, p: str, v: str) -> DataFrame:
    """Count and deciles of ``value`` by both bins, by the first, and overall, in one pass."""
    out = rows.where(F.col(value).isNotNull()).groupingSets([[F.col(p), F.col(v)], [F.col(p)], []], F.col(p), F.col(v))
    return out.agg(F.count("*").alias("n"), *[F.round(F.percentile(value, q), 6).alias(f"p{int(q * 100)}") for q in (0.1, 0.5, 0.9)])


def scenario_cells(rows: DataFrame, p_bin: Column, v_bin: Column, value: str, up: Column, down: Column) -> DataFrame:
    """Scenarios by both bins, by the first, and overall, in one pass: level (0, 1, 2), p, v, n, deciles of ``value``, and the shares of rows that touch up,
    down, both or neither."""
    r = rows.where(F.col(value).isNotNull()).withColumns({"p": p_bin, "v": v_bin, "_u": up, "_d": down})
    share = lambda c: F.avg(c.cast("double"))
    u, d = F.col("_u"), F.col("_d")
    g = r.groupingSets([[F.col("p"), F.col("v")], [F.col("p")], []], F.col("p"), F.col("v")).agg(
        F.bit_count(F.grouping_id()).cast("int").alias("level"), F.count("*").alias("n"), *[F.percentile(value, q).alias(f"p{int(q * 100)}") for q in (0.1, 0.5, 0.9)],
        share(u).alias("touch_up"), share(d).alias("touch_down"), share(u & d).alias("touch_both"), share(~u & ~d).alias("touch_neither"))
    return g


def scenario_lookup(items: DataFrame, cells: DataFrame, p_bin: Column, v_bin: Column, least: int) -> DataFrame:
    """Items with their scenario: of both bins if it has ``least`` rows, else of the first bin, else the overall one. The levels are one
    table of few rows: an item asks for its three keys in one join and keeps the narrowest answer that is large enough."""
    key = lambda level, p, v: F.concat_ws("|", level.cast("string"), F.when(level < 2, p).cast("string"), F.when(level < 1, v).cast("string"))
    table = cells.where((F.col("n") >= least) | (F.col("level") == 2)).select(key(F.col("level"), F.col("p"), F.col("v")).alias("_key"), F.struct("level", *[c for c in cells.columns if c not in ("p", "v", "level")]).alias("_cell"))
    asked = items.withColumn("_id", F.monotonically_increasing_id()).withColumns({"_p": p_bin, "_v": v_bin})
    asked = asked.withColumn("_key", F.explode(F.array(*[key(F.lit(level), F.col("_p"), F.col("_v")) for level in range(3)])))
    found = asked.join(table, "_key").groupBy("_id", *items.columns).agg(F.min("_cell").alias("_cell"))  # level leads the struct
    return found.select(*items.columns, "_cell.*")


def slices(trades: DataFrame, days: int, name: str, anchor: int = 0) -> DataFrame:
    """Trades and net by symbol and period of so many days (``name``), periods without trades as zeros between the first and the last."""
    at = F.floor((F.col("event_ms") - anchor) / (days * DAY)).cast("long")
    g = trades.where("net_bps is not null").groupBy("symbol", at.alias(name)).agg(F.count("*").alias("trades"), F.sum("net_bps").alias("net"))
    whole = g.groupBy("symbol").agg(F.explode(F.sequence(F.min(name), F.max(name))).alias(name))
    return whole.join(g, ["symbol", name], "left").select("symbol", name, F.coalesce("trades", F.lit(0)).alias("trades"), F.round(F.coalesce("net", F.lit(0.0)), 5).alias("net"))


def weekly(trades: DataFrame, anchor: int = 0) -> DataFrame:
    return slices(trades, 7, "week", anchor)


def disjoint_sums_ratio(bars: DataFrame, width: int = 12, count: int = 24) -> DataFrame:
    """Volume of the last ``width`` rows over the median of ``count`` earlier disjoint sums; null with fewer rows."""
    w = series()
    r = bars.withColumns({"s": F.sum("volume").over(w.rowsBetween(1 - width, 0)), "rn": F.row_number().over(w)})
    r = r.withColumn("old", F.sort_array(F.array(*[F.lag("s", width * k).over(w) for k in range(1, count + 1)])))
    median = (F.element_at("old", count // 2) + F.element_at("old", count // 2 + 1)) / 2
    return r.select("symbol", "open_time_ms", F.when(F.col("rn") >= width * (count + 1), ratio(F.col("s"), median)).alias("ratio"))


def history_with_fallback(items: DataFrame, history: DataFrame, least: int = 10) -> DataFrame:
    """Each item's share of wins from the narrowest history with enough rows: symbol and regime, regime, all.
    Histories are aggregated first, so items meet three small tables instead of rows."""
    agg = lambda *k: history.groupBy(*k).agg(F.count("*").alias("n"), F.avg("win").alias("p"))
    name = lambda df, i: df.withColumnsRenamed({"n": f"n{i}", "p": f"p{i}"})
    j = items.join(name(agg("symbol", "regime"), 0), ["symbol", "regime"], "left").join(name(agg("regime"), 1), "regime", "left").crossJoin(F.broadcast(name(agg(), 2)))
    level = F.when(F.col("n0") >= least, 0).when(F.col("n1") >= least, 1).otherwise(2)
    pick = lambda c: F.when(F.col("level") == 0, F.col(f"{c}0")).when(F.col("level") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    return j.withColumn("level", level).select(*items.columns, "level", pick("n").alias("n"), F.round(pick("p"), 9).alias("rate"))


def multi_touch(bars: DataFrame, horizon: int, levels: tuple[float, ...] = (2, 3, 5)) -> DataFrame:
    """For every row with a whole horizon after it and each level in percent: is it touched, from forward maxima."""
    w = series()
    ahead = w.rowsBetween(1, horizon)
    r = bars.select("symbol", "open_time_ms", "close", F.max("high").over(ahead).alias("top"), F.min("low").over(ahead).alias("bottom"), F.count("*").over(ahead).alias("n")).where(F.col("n") == horizon)
    r = r.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    return r.select("symbol", "level", (F.col("top") >= F.col("close") * (1 + F.col("level") / 100)).cast("int").alias("up"), (F.col("bottom") <= F.col("close") * (1 - F.col("level") / 100)).cast("int").alias("down")) \
        .groupBy("symbol", "level").agg(F.count("*").alias("n"), F.sum("up").alias("up"), F.sum("down").alias("down"))


def append_new(ledger: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """Rows whose key the ledger lacks, one for each key: appending twice adds nothing."""
    return rows.dropDuplicates(list(key)).join(ledger.select(*key), list(key), "left_anti")


def common_window(bars: DataFrame) -> DataFrame:
    """Rows inside the time that every series covers."""
    ends = bars.groupBy("symbol").agg(F.min("open_time_ms").alias("a"), F.max("open_time_ms").alias("b")).agg(F.max("a").alias("a"), F.min("b").alias("b"))
    return bars.crossJoin(F.broadcast(ends)).where("open_time_ms between a and b").drop("a", "b")


def daily_quota(rows: DataFrame, score: str, limit: int) -> DataFrame:
    """The best rows of each day by score, then symbol and time; one for each symbol and day."""
    day = F.floor(F.col("open_time_ms") / DAY).cast("long")
    once = rows.withColumn("day", day).groupBy("symbol", "day").agg(F.max(F.struct(score, (-F.col("open_time_ms")).alias("t"))).alias("m"))
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc(f"m.{score}"), "symbol"))
    return once.withColumn("place", place).where(F.col("place") <= limit).select("symbol", "day", "place", (-F.col("m.t")).alias("open_time_ms"))
