"""Candles from streams: tumbling aggregation under a watermark, and a confirmed regime kept in state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.sources.files import scratch

HOUR = 3_600_000
#: Whole hours from year 1 to 1970 in milliseconds. A watermark begins at 1970 and drops what ends before it, so event times are counted from year 1.
EARLIEST = 62_135_596_800_000
BARS = "symbol string, open_time_ms long, close double, volume double"
REGIME = "symbol string, open_time_ms long, raw string, regime string"


def _scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a local one only where none is set."""
    return scratch(spark, name)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    path = f"{sf_dir}/events.parquet"
    # a pattern, as a stream takes a single file only through one
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def tumbling_bars(ticks: DataFrame, late: str = "2 hours") -> DataFrame:
    """One candle for each type and hour, emitted once when the watermark passes its end."""
    price = F.col("value") + 1
    seq = F.struct("ts", "event_id")
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + EARLIEST * 1000)
    rows = ticks.select(F.col("event_type").alias("symbol"), at.alias("at"), seq.alias("seq"), price.alias("price"))
    g = rows.withWatermark("at", late).groupBy("symbol", F.window("at", "1 hour").alias("w")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.count("*").alias("trade_count"))
    return g.select("symbol", (F.unix_millis("w.start") - EARLIEST).alias("open_time_ms"), "open", "high", "low", "close", "trade_count")


def finished(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Runs the stream over all that is there now; its offsets, state and rows lie in the shared folder, so that a
    restart goes on where it stopped."""
    out = _scratch(spark, name)
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def stored_bars(spark: SparkSession, bars: DataFrame) -> str:
    path = _scratch(spark, "bars")
    bars.select("symbol", "open_time_ms", "close", "volume").write.parquet(path)
    return path


def bar_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(BARS).parquet(path)


def advance(state: tuple, t: int, raw: str, step: int = HOUR, enter: int = 3, leave: int = 2) -> tuple[tuple, str]:
    """One bar of the confirmation machine. State: last time, regime, bars that ask for a change.

    BULL after ``enter`` consecutive bars that say so, left after ``leave`` that do not. A gap makes the
    regime UNKNOWN until it is earned anew; an older or equal bar changes nothing.
    """
    last, regime, asks = state
    if last is not None and t <= last:
        return state, "UNKNOWN" if t < last else regime
    if last is not None and t != last + step:
        regime, asks = "UNKNOWN", 0
    asks = asks + 1 if (raw == "BULL") != (regime == "BULL") else 0
    if raw == "BULL" and asks >= enter:
        regime, asks = "BULL", 0
    elif raw != "BULL" and (regime != "BULL" or asks >= leave):
        regime, asks = raw, 0
    return (t, regime, asks), regime


def regimes(bars: DataFrame) -> DataFrame:
    """(symbol, open_time_ms, raw, regime); the state of a symbol is three values."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (None, "UNKNOWN", 0)
        rows = pd.concat(batches).sort_values("open_time_ms", kind="stable")
        out = []
        for t, volume in zip(rows["open_time_ms"], rows["volume"]):
            raw = "BULL" if volume >= 2 else "OFF"
            now, regime = advance(now, int(t), raw)
            out.append((key[0], int(t), raw, regime))
        state.update(now)
        yield pd.DataFrame(out, columns=["symbol", "open_time_ms", "raw", "regime"])

    return bars.groupBy("symbol").applyInPandasWithState(run, REGIME, "last long, regime string, asks int", "append", "NoTimeout")
