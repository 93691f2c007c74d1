"""A signal ledger derived from the orders table: one signal for each order, every field from integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.sources.bars import read

FAMILIES, REGIMES, STEP = ("F1", "F2", "F3", "B1", "B2"), ("BULL", "TRANSITION", "OFF"), 300_000


def pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, cents = F.col("o_orderkey"), F.col("cents")
    div = lambda x, n: F.floor(x / n).cast("long")
    o = read(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    first, second, horizon = pick(FAMILIES, u % 5), pick(FAMILIES, div(u, 5) % 5), pick((15, 30, 60), div(u, 2) % 3)
    bar = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + (u % 288) * STEP + (STEP - 1)
    r = o.select(
        u.alias("id"), F.concat(F.lit("C"), (F.col("o_custkey") % 60).cast("string")).alias("symbol"), first.alias("family"),
        F.when(u % 3 == 0, F.array_sort(F.array_distinct(F.array(first, second)))).otherwise(F.array(first)).alias("families"),
        pick(REGIMES, div(u, 3) % 3).alias("regime"), F.when(u % 2 == 0, "LONG").otherwise("SHORT").alias("direction"), horizon.alias("horizon"),
        ((cents % 400) / 100.0).alias("score"), (cents % 601 - 280).cast("double").alias("gross"), (u % 5 + 10).cast("double").alias("cost"), bar.alias("bar_ms"),
        (cents % 3 == 0).alias("notified"), F.when(u % 17 != 0, (cents % 97) / 10.0).alias("spread_bps"), ((cents % 1000) * 10_000.0).alias("quote_volume"), (u % 41 - 20).cast("double").alias("funding_bps"),
        (cents % 131).cast("double").alias("volatility_bps"), F.when(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp"), "p1").otherwise("p2").alias("policy"))
    status = F.when(F.col("gross") >= 150, "TARGET").when(F.col("gross") <= -150, "STOP").otherwise("TIME_EXIT")
    return r.withColumns({
        "net": F.when(F.col("id") % 11 != 0, F.col("gross") - F.col("cost")), "status": F.when(F.col("id") % 13 != 0, status), "settled_ms": F.col("bar_ms") + F.col("horizon") * 60_000,
        "strategy": strategy(F.col("direction") == "LONG", F.array_contains("families", "F2"), F.col("regime") == "BULL")})


def strategy(up: Column, flush: Column, bull: Column) -> Column:
    """The playbook of a direction, families and regime; first that fits."""
    return (F.when(up & flush, "FLUSH_RECOVERY_LONG").when(up & bull, "BULL_CONTINUATION_LONG").when(~up & bull, "BULL_EXHAUSTION_SHORT")
            .when(~up & flush, "DOWNSIDE_CONTINUATION_SHORT").when(up, "DIRECTIONAL_LONG").otherwise("DIRECTIONAL_SHORT"))
