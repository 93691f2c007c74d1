"""Candle tables: derived from the driver's tables, resampled, validated and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000, 86_400_000
PRICES = ("open", "high", "low", "close")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _candles(ticks: DataFrame, step: int) -> DataFrame:
    """Ticks (symbol, ms, seq, price, size, value, taker) to one candle for each symbol and step."""
    start = (F.col("ms") - F.pmod("ms", F.lit(step))).alias("open_time_ms")
    return ticks.groupBy("symbol", start).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
        F.sum("size").alias("volume"), F.round(F.sum("value"), 2).alias("quote_volume"), F.count("*").alias("trade_count"), F.sum("taker").alias("taker_buy_base"),
    ).withColumn("close_time_ms", F.col("open_time_ms") + step - 1)


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return _candles(li.select(
        F.col("l_returnflag").alias("symbol"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ms"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"), F.col("l_extendedprice").alias("value"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0).alias("taker")), DAY)


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events")
    price = F.col("value") + 1
    return _candles(ev.select(
        F.col("event_type").alias("symbol"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.struct("ts", "event_id").alias("seq"), price.alias("price"),
        F.lit(1.0).alias("size"), price.alias("value"), F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(0.0).alias("taker")), HOUR)


def calm(bars: DataFrame, base: float = 1000.0, scale: float = 1000.0) -> DataFrame:
    """The candles with prices pressed into a narrow band above ``base``, in the same order, so that thresholds in
    percent mean something on tables whose prices differ by a thousand times from trade to trade."""
    return bars.withColumns({c: F.lit(base) + F.col(c) / scale for c in PRICES})


def resample(bars: DataFrame, step: int, to: int) -> DataFrame:
    """Coarser candles; only buckets with every fine candle are kept."""
    start = (F.col("open_time_ms") - F.pmod("open_time_ms", F.lit(to))).alias("bucket_ms")
    return bars.groupBy("symbol", start).agg(
        F.min_by("open", "open_time_ms").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time_ms").alias("close"),
        F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count"), F.count("*").alias("n")).where(F.col("n") == to // step).drop("n")


NUMBERS = (*PRICES, "volume", "quote_volume", "taker_buy_base")


def violation(step: int, columns: tuple[str, ...] = NUMBERS) -> Column:
    """The first rule that a candle breaks, or null: keys, every number finite, positive prices, no negative volume or
    count, taker volume within the volume, high and low around the others, times on the grid."""
    whole = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    finite = F.lit(True)
    for c in (*columns, "trade_count"):
        finite = finite & whole(c)
    return (
        F.when(F.col("symbol").isNull() | F.col("open_time_ms").isNull() | F.col("close_time_ms").isNull(), "key")
        .when(~finite, "not finite")
        .when(F.least(*PRICES) <= 0, "price")
        .when((F.col("volume") < 0) | (F.col("trade_count") < 0) | (F.col("quote_volume") < 0) | (F.col("taker_buy_base") < 0), "volume")
        .when(F.col("taker_buy_base") > F.col("volume") * 1.0001 + 1e-8, "taker")
        .when(F.col("high") < F.greatest("open", "close", "low"), "high")
        .when(F.col("low") > F.least("open", "close", "high"), "low")
        .when((F.col("open_time_ms") % step != 0) | (F.col("close_time_ms") != F.col("open_time_ms") + step - 1), "grid")
    )


def repeated(bars: DataFrame) -> Column:
    """Is the candle's open time found more than once in its series?"""
    return F.count("*").over(Window.partitionBy("symbol", "open_time_ms")) > 1


def validated(bars: DataFrame, step: int, mode: str = "quarantine") -> DataFrame:
    """``quarantine``: rows with ``violation``; ``drop``: good rows only; ``strict``: an error at the first bad row."""
    out = bars.withColumn("violation", violation(step))
    if mode == "drop":
        return out.where("violation is null").drop("violation")
    if mode == "strict":
        return out.where(F.when(F.col("violation").isNotNull(), F.raise_error(F.concat(F.lit("invalid candle: "), "violation"))).otherwise(F.lit(True))).drop("violation")
    return out


def keep_last(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new candles; for equal symbol and open time the new one wins, and among equals of one source the one with
    the largest hash of its columns, whatever the order of the rows."""
    cols = [c for c in old.columns if c not in ("symbol", "open_time_ms")]
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    return both.groupBy("symbol", "open_time_ms").agg(F.max_by(F.struct(*cols), F.struct("_src", F.xxhash64(*cols))).alias("r")).select("symbol", "open_time_ms", "r.*")


def series() -> Window:
    return Window.partitionBy("symbol").orderBy("open_time_ms")


def contiguous_tail(bars: DataFrame, step: int) -> DataFrame:
    """Rows from each symbol's last gap onward; all rows if there is none."""
    gap = F.when(F.col("open_time_ms") - F.lag("open_time_ms").over(series()) != step, F.col("open_time_ms"))
    marked = bars.withColumn("_gap", gap).withColumn("_last", F.max("_gap").over(Window.partitionBy("symbol")))
    return marked.where("_last is null or open_time_ms >= _last").drop("_gap", "_last")


def segments(bars: DataFrame, step: int) -> DataFrame:
    """The rows with ``segment``, a number that grows at each gap of the symbol."""
    gap = (F.col("open_time_ms") - F.lag("open_time_ms").over(series()) != step).cast("int")
    return bars.withColumn("_gap", F.coalesce(gap, F.lit(0))).withColumn("segment", F.sum("_gap").over(series().rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def longest_segment(bars: DataFrame, step: int) -> DataFrame:
    """Each symbol's longest gap-free run; the first among equals."""
    sizes = segments(bars, step).groupBy("symbol", "segment").agg(F.count("*").alias("n"), F.min("open_time_ms").alias("start_ms"), F.max("open_time_ms").alias("end_ms"))
    first = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("n"), "segment"))
    return sizes.withColumn("_r", first).where("_r = 1").select("symbol", "n", "start_ms", "end_ms")


def grid_gaps(bars: DataFrame, step: int) -> DataFrame:
    """Per symbol: candles, gaps, missing candles, largest gap in steps."""
    d = (F.col("open_time_ms") - F.lag("open_time_ms").over(series())) / step
    return bars.withColumn("d", d).groupBy("symbol").agg(
        F.count("*").alias("bars"), F.count_if(F.col("d") > 1).alias("gaps"), F.coalesce(F.sum(F.when(F.col("d") > 1, F.col("d") - 1)), F.lit(0.0)).cast("long").alias("missing"), F.max("d").cast("long").alias("largest"))
