"""A registry of event rules: each is one boolean column over window columns of a series."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.scalars import frame, guarded, ratio, series


def rule_columns(bars: DataFrame, n: int = 12, base: int = 20) -> DataFrame:
    """What the rules read: volume z, prior high, mean and deviation of the close, fall over three rows."""
    w = series()
    b, last = frame(w, base), F.col("close")
    z = lambda x: F.when(F.count(x).over(b) >= base, ratio(x - F.avg(x).over(b), F.stddev_pop(x).over(b)))
    r = bars.withColumns({"vz": z(F.col("volume")), "cz": z(last), "prior_high": guarded(F.max, F.col("high"), frame(w, n, -1), n), "fall": last / F.lag("close", 3).over(w) - 1})
    return r.withColumns({"pc": F.lag("close").over(w), "ph": F.lag("prior_high").over(w), "pz": F.lag("cz").over(w), "pfall": F.lag("fall").over(w), "phigh": F.lag("high").over(w)})


def volume_momentum(min_z: float = 1.0) -> Column:
    return (F.col("vz") >= min_z) & (F.col("close") > F.col("open"))


def cross_above(min_z: float = 0.0) -> Column:
    """Closes above the prior high, the row before did not."""
    return (F.col("close") > F.col("prior_high")) & (F.col("pc") <= F.col("ph")) & (F.col("vz") >= min_z)


def snap_back(k: float = 2.0) -> Column:
    """Back inside the lower band after a close below it."""
    return (F.col("pz") < -k) & (F.col("cz") >= -k)


def reclaim(fall: float = 0.1, min_z: float = 0.0) -> Column:
    """A sharp fall, then a close above the high of the row before, on volume."""
    return (F.col("pfall") <= -fall) & (F.col("close") > F.col("phigh")) & (F.col("vz") >= min_z)


RULES: dict[str, Callable[[], Column]] = {"VOLUME": volume_momentum, "CROSS": cross_above, "SNAP_BACK": snap_back, "RECLAIM": reclaim}


def rule_hits(bars: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """(symbol, open_time_ms, rule): one row for each rule that holds, from one pass over the windows."""
    rules = rules or {k: f() for k, f in RULES.items()}
    hits = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return rule_columns(bars).select("symbol", "open_time_ms", F.explode(hits).alias("rule"))


def first_reason(*gates: tuple[str, Column]) -> Column:
    """The name of the first gate that fails (false or unknown), or 'passed'."""
    start = F.when(F.lit(False), F.lit(""))
    return reduce(lambda c, g: c.when(~F.coalesce(g[1], F.lit(False)), g[0]), gates, start).otherwise("passed")


def volume_profile(bars: DataFrame, period: int, rows: int = 40) -> DataFrame:
    """Point of control of each symbol and period: the price row (of ``rows`` equal ones between the period's low
    and high) with most volume, each candle's volume spread over the rows that it overlaps; lowest row on ties."""
    span = bars.withColumn("bucket_ms", F.col("open_time_ms") - F.pmod("open_time_ms", F.lit(period)))
    ends = span.groupBy("symbol", "bucket_ms").agg(F.min("low").alias("lo"), F.max("high").alias("hi")).where("hi > lo")
    # a candle meets only the rows that it overlaps, not all of them
    r = span.join(ends, ["symbol", "bucket_ms"]).withColumn("width", (F.col("hi") - F.col("lo")) / rows)
    at = lambda x: F.least(F.floor((x - F.col("lo")) / F.col("width")), F.lit(rows - 1)).cast("int")
    r = r.withColumn("row", F.explode(F.sequence(at(F.col("low")), at(F.col("high")))))
    bottom = F.col("lo") + F.col("row") * F.col("width")
    overlap = F.greatest(F.least("high", bottom + F.col("width")) - F.greatest("low", bottom), F.lit(0.0))
    share = F.when(F.col("high") > F.col("low"), overlap / (F.col("high") - F.col("low"))).otherwise(1.0)
    v = r.groupBy("symbol", "bucket_ms", "row", "lo", "width").agg(F.round(F.sum(F.col("volume") * share), 6).alias("v"))
    best = v.groupBy("symbol", "bucket_ms").agg(F.max(F.struct("v", (-F.col("row")).alias("r"), (F.col("lo") + (F.col("row") + 0.5) * F.col("width")).alias("poc"))).alias("m"))
    return best.select("symbol", "bucket_ms", (-F.col("m.r")).alias("row"), "m.poc", F.col("m.v").alias("volume"))
