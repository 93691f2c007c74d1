"""Exponentially weighted means (adjust=False) without recursion.

y0 = x0, y = a x + (1 - a) y'. With q = 1 - a, rows are cut into blocks of about 60/a; inside a block the value is
q^pos times a running sum of weighted x q^-pos, and the value at the last block's end is carried in, the newest
non-null one before the row. q^block is about e^-60, so only that block matters. All windows have the series as
their partition: one shuffle for any number of means, no join, and running frames that hold a single row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ewms(rows: DataFrame, means: dict[str, tuple[str, float, int]], keys: tuple[str, ...] = ("symbol",), order: str = "open_time_ms") -> DataFrame:
    """``rows`` with a column for each entry ``to: (value, alpha, least)``; null until ``least`` values. Values have no
    nulls inside the series (leading nulls are skipped)."""
    w = Window.partitionBy(*keys).orderBy(order)
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    values = sorted({v for v, _, _ in means.values()})
    names = {v: f"_rn{i}" for i, v in enumerate(values)}
    r = rows.withColumns({n: F.sum(F.when(F.col(v).isNotNull(), 1).otherwise(0)).over(sofar) - 1 for v, n in names.items()})
    blocks = {to: math.ceil(60 / a) for to, (_, a, _) in means.items()}
    r = r.withColumns({f"_b{i}": F.floor(F.col(names[v]) / blocks[to]).cast("long") for i, (to, (v, _, _)) in enumerate(means.items())})
    pos = {to: (F.col(names[v]) % blocks[to]).cast("double") for to, (v, _, _) in means.items()}
    for i, (to, (v, a, _)) in enumerate(means.items()):
        weight = F.when(F.col(names[v]) == 0, 1.0).otherwise(a)
        inside = Window.partitionBy(*keys, f"_b{i}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        r = r.withColumn(f"_y{i}", F.pow(F.lit(1 - a), pos[to]) * F.sum(weight * F.col(v) * F.pow(F.lit(1 - a), -pos[to])).over(inside))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ends = {f"_c{i}": F.last(F.when(pos[to] == blocks[to] - 1, F.col(f"_y{i}")), ignorenulls=True).over(before) for i, to in enumerate(means)}
    r = r.withColumns(ends)
    out = {to: F.when(F.col(names[v]) + 1 >= least, F.col(f"_y{i}") + F.pow(F.lit(1 - a), pos[to] + 1) * F.coalesce(F.col(f"_c{i}"), F.lit(0.0))) for i, (to, (v, a, least)) in enumerate(means.items())}
    return r.withColumns(out).drop(*names.values(), *[f"_{c}{i}" for c in "byc" for i in range(len(means))])


def ewm(rows: DataFrame, value: str, alpha: float, to: str, least: int = 1, keys: tuple[str, ...] = ("symbol",), order: str = "open_time_ms") -> DataFrame:
    return ewms(rows, {to: (value, alpha, least)}, keys, order)


def span(n: int) -> float:
    return 2 / (n + 1)
