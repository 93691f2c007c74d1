"""Column builders for candle arithmetic. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def frame(w: WindowSpec, n: int, upto: int = 0) -> WindowSpec:
    """The n rows that end ``upto`` rows after (negative: before) the current one."""
    return w.rowsBetween(upto - n + 1, upto)


def guarded(agg, x: Column, w: WindowSpec, least: int) -> Column:
    """A window aggregate that is null until the frame has ``least`` values."""
    return F.when(F.count(x).over(w) >= least, agg(x).over(w))


def true_range(w: WindowSpec) -> Column:
    """Null parts are skipped: the first candle has high - low."""
    before = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def linear_bps(entry: Column, exit_: Column, side: Column | int = 1) -> Column:
    return (exit_ / entry - 1) * 10_000 * side


def log_bps(entry: Column, exit_: Column) -> Column:
    return F.log(exit_ / entry) * 10_000


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper bound of a share; null without observations."""
    n = F.nullif(n, F.lit(0))
    p, zz = hits / n, z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    some = n.isNotNull()
    return F.when(some, F.greatest(F.lit(0.0), mid - half)), F.when(some, F.least(F.lit(1.0), mid + half))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), x))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for a zero divisor."""
    return a / F.nullif(b, F.lit(0.0))


def series() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("open_time_ms")
