"""An ordered pattern: a narrow range, a sweep beyond it, the return inside, and a close across its point of control."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.functions.scalars import frame, series
from candela.operators import folds
from candela.operators.market import accumulation

DAY = 86_400_000
OUT = "open_time_ms long, side string, poc double, stop double, sweep_ms long"


def ranges_with_poc(bars: DataFrame, least: int = 20, most: int = 60, k: float = 2.0, rows: int = 40) -> DataFrame:
    """Each candle that ends a narrow range, with the range's point of control: the price row with most volume, each candle's volume
    spread over the rows it overlaps; the lowest row on ties."""
    hist = bars.select("symbol", "open_time_ms", F.collect_list(F.struct("low", "high", "volume")).over(frame(series(), most)).alias("hist"))
    r = accumulation(bars, least, most, k).join(hist, ["symbol", "open_time_ms"])
    r = r.withColumns({"hist": F.slice("hist", -F.col("n"), F.col("n")), "width": (F.col("range_high") - F.col("range_low")) / rows})

    def volume(i):
        bottom = F.col("range_low") + i * F.col("width")
        share = lambda x: F.when(x.high > x.low, F.greatest(F.least(x.high, bottom + F.col("width")) - F.greatest(x.low, bottom), F.lit(0.0)) / (x.high - x.low)).otherwise(((x.low >= bottom) & (x.low < bottom + F.col("width"))).cast("double"))
        return F.aggregate("hist", F.lit(0.0), lambda s, x: s + x.volume * share(x))

    r = r.withColumn("volumes", F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), volume))
    row = F.array_position("volumes", F.array_max("volumes")) - 1
    return r.select("symbol", "open_time_ms", "range_low", "range_high", (F.col("range_low") + (row + 0.5) * F.col("width")).alias("poc"))


class Setup(NamedTuple):
    """A pattern on its way. ``side``: 0 until one end of the range is swept, then 1 (below) or -1; ``extreme``: the farthest price since;
    ``age``: candles since the sweep; ``inside``: a candle has closed back inside the range; ``before``: the last close."""

    low: float
    high: float
    poc: float
    side: int
    extreme: float
    swept_ms: int
    age: int
    inside: bool
    before: float


STATE = "low double, high double, poc double, side int, extreme double, swept_ms bigint, age int, inside boolean, before double"


def sweep_step(s: Setup | None, candle: tuple, valid: int) -> tuple[Setup | None, tuple | None]:
    """The setup after a candle (time, high, low, close, range low, range high, poc; the last three null where no range ends), and a
    signal or None. A candle that sweeps both ends counts as neither; a setup ends ``valid`` candles after its sweep."""
    t, high, low, close, *found = candle
    if s is None:
        new = found[0] is not None and found[0] == found[0]
        return (Setup(*map(float, found), 0, 0.0, 0, 0, False, float(close)) if new else None), None
    reach = {1: low, -1: high}
    if s.side:
        s = s._replace(age=s.age + 1)
    else:
        swept = [d for d, beyond in ((1, low < s.low), (-1, high > s.high)) if beyond]
        if len(swept) == 1:
            s = s._replace(side=swept[0], extreme=float(reach[swept[0]]), swept_ms=int(t))
    if s.side and not s.inside:
        farther = min if s.side > 0 else max
        back = close > s.low if s.side > 0 else close < s.high
        s = s._replace(extreme=float(farther(s.extreme, reach[s.side])), inside=bool(back))
        return (None if back and s.age > valid else s._replace(before=float(close))), None
    if s.side and s.age > valid:
        return None, None
    if s.side and s.side * (close - s.poc) > 0 >= s.side * (s.before - s.poc):
        return None, (int(t), "LONG" if s.side > 0 else "SHORT", s.poc, s.extreme, s.swept_ms)
    return s._replace(before=float(close)), None


def follow(candles: Iterable[tuple], valid: int = 12, setup: Setup | None = None) -> tuple[Setup | None, list[tuple]]:
    """The setup left open after the candles, and the signals."""
    out = []
    for c in candles:
        setup, made = sweep_step(setup, c, valid)
        if made:
            out.append(made)
    return setup, out


def sweep_signals(bars: DataFrame, valid: int = 12, bound: int = folds.BOUND, **limits) -> DataFrame:
    """(symbol, time, side, poc, stop, sweep time). The order of events decides: series are followed in chunks (``folds``), and only three
    numbers of each candle and its range travel there."""
    r = bars.select("symbol", "open_time_ms", "high", "low", "close").join(ranges_with_poc(bars, **limits), ["symbol", "open_time_ms"], "left")
    cols = ["open_time_ms", "high", "low", "close", "range_low", "range_high", "poc"]
    cut = folds.chunked(r, ("symbol",), F.floor(F.col("open_time_ms") / DAY).cast("long"), bound)
    return folds.folded(cut, ("symbol",), [F.col("open_time_ms")], cols, STATE, OUT, lambda s, rows: follow(rows, valid, s and Setup(*s)))
