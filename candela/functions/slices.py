"""Series windows cut in time: a long series is many tasks, each with the rows that its windows reach."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000
#: Stands between a series' name and its slice while a slice is a series of its own.
MARK = "\x1f"


def numbered(rows: DataFrame, to: str, key: str = "symbol", order: str = "open_time_ms", slot_ms: int = DAY) -> DataFrame:
    """``rows`` with their number in the series, from 0: counts of days are added up first, so only a day is ever sorted at once."""
    r = rows.withColumn("_slot", F.floor(F.col(order) / slot_ms))
    sizes = r.groupBy(key, "_slot").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))  # one row for each day
    r = r.join(sizes.select(key, "_slot", F.coalesce(before, F.lit(0)).alias("_before")), [key, "_slot"])
    inside = F.row_number().over(Window.partitionBy(key, "_slot").orderBy(order)) - 1
    return r.withColumn(to, F.col("_before") + inside).drop("_slot", "_before")


def in_slices(rows: DataFrame, f: Callable[[DataFrame], DataFrame], before: int, after: int = 0, size: int = 65_536, key: str = "symbol", order: str = "open_time_ms") -> DataFrame:
    """``f`` of the rows, computed on slices of ``size`` rows of a series, each with ``before`` rows before it and ``after`` behind it.

    ``f`` takes and gives rows with ``key`` and ``order``; it sees every slice as a series of its own, so its windows by ``key`` are as
    many tasks as there are slices. What it gives for a slice's own times is kept. The result is that of the whole series where a row
    depends on at most ``before`` rows before and ``after`` behind it; a mean whose weights fall by q a row forgets to within e^-60 after 60 / -ln q rows.
    """
    n = numbered(rows, "_rn", key, order)
    own = F.floor(F.col("_rn") / size)
    reach = lambda d: F.floor((F.col("_rn") + d) / size)
    copies: Column = F.sequence(F.greatest(F.lit(0), reach(-after)), reach(before))
    last = n.groupBy(key).agg(F.floor(F.max("_rn") / size).alias("_last"))
    name = F.concat_ws(MARK, F.col(key).cast("string"), F.col("_slice").cast("string"))
    ends = n.groupBy(key, own.alias("_slice")).agg(F.min(order).alias("_from"), F.max(order).alias("_to")).select(name.alias(key), "_from", "_to")
    cut = n.join(last, key).withColumn("_slice", F.explode(copies)).where(F.col("_slice") <= F.col("_last")).withColumn(key, name)
    out = f(cut.select(*rows.columns)).join(ends, key).where(F.col(order).between(F.col("_from"), F.col("_to"))).drop("_from", "_to")
    return out.withColumn(key, F.substring_index(key, MARK, 1).cast(rows.schema[key].dataType))
