"""Statistical operators: logistic fits by Spark ML, calibration, backtest measures and gates, splits, imputation, selection."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.scalars import ratio, wilson

DAY = 86_400_000


def bonferroni_z(models: int) -> float:
    """Two-sided 95 % level shared by so many models."""
    return NormalDist().inv_cdf(1 - 0.05 / (2 * max(1, models)))


def fit_logistic(rows: DataFrame, features: tuple[str, ...], target: str, l2: float = 1.0) -> tuple[float, list[float]]:
    """Intercept and coefficients that minimise the summed log loss plus l2/2 times the coefficients' squared norm. Spark averages
    the loss, so its penalty is l2 / n; nothing is standardised and the intercept is not penalised."""
    data = VectorAssembler(inputCols=list(features), outputCol="x").transform(rows.select(*features, F.col(target).cast("double").alias("y")))
    n = data.count()
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=l2 / n, elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-12).fit(data)
    return model.intercept, list(model.coefficients)


def linear(features: tuple[str, ...], intercept: float, weights: list[float]) -> Column:
    return sum((F.col(c) * w for c, w in zip(features, weights)), F.lit(intercept))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), x))))


def fit_platt(rows: DataFrame, logit: str, target: str) -> tuple[float, float]:
    """Slope and intercept of a calibration of ``logit`` (slope penalty 0.01). One label only, no spread, or a negative slope: slope 0
    and the base rate."""
    y = F.col(target).cast("double")
    n, mean, spread = rows.agg(F.count("*"), F.avg(y), F.stddev_pop(logit)).first()
    rate = min(max(mean or 0.0, 1e-4), 1 - 1e-4)
    base = (0.0, math.log(rate / (1 - rate)))
    if not n or mean in (0.0, 1.0) or (spread or 0.0) < 1e-9:
        return base
    intercept, (slope,) = fit_logistic(rows, (logit,), target, 0.01)
    return base if slope < 0 or not math.isfinite(slope + intercept) else (slope, intercept)


def standard_scale(rows: DataFrame, features: tuple[str, ...], train: Column) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature over the training rows; a deviation below 1e-9 is one."""
    r = rows.where(train).agg(*[f(c).alias(f"{k}{c}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (r[f"m{c}"], r[f"s{c}"] if r[f"s{c}"] and r[f"s{c}"] >= 1e-9 else 1.0) for c in features}


def scaled(rows: DataFrame, scale: dict[str, tuple[float, float]], clip: float = 8.0) -> DataFrame:
    return rows.withColumns({c: F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(c) - m) / s)) for c, (m, s) in scale.items()})


def imputed(rows: DataFrame, features: tuple[str, ...], train: Column) -> DataFrame:
    """Nulls filled with the training rows' medians, and an indicator column ``<name>_missing`` for each feature."""
    medians = rows.where(train).agg(*[F.percentile(c, 0.5).alias(f"_m_{c}") for c in features])
    r = rows.crossJoin(F.broadcast(medians))  # one row
    return r.withColumns({**{f"{c}_missing": F.col(c).isNull().cast("int") for c in features}, **{c: F.coalesce(c, f"_m_{c}") for c in features}}).drop(*[f"_m_{c}" for c in features])


def scored_threshold(rows: DataFrame, score: str, role: str, *fold: str, share: float = 0.8) -> DataFrame:
    """Test rows whose score reaches the calibration rows' 80 % quantile of their fold."""
    cut = rows.where(F.col(role) == "calibration").groupBy(*fold).agg(F.percentile(score, share).alias("threshold"))
    return rows.where(F.col(role) == "test").join(cut, list(fold)).where(F.col(score) >= F.col("threshold"))


def nested(p: dict[int, str]) -> dict[str, Column]:
    """Probabilities of rising levels made monotone: a higher level is never likelier than a lower one."""
    out, best = {}, None
    for level in sorted(p):
        best = F.col(p[level]) if best is None else F.least(F.col(p[level]), best)
        out[p[level]] = best
    return out


def side_choice(long: Column, short: Column, margin: float, least: float) -> Column:
    """LONG or SHORT if it is likely enough and ahead by the margin, else NONE."""
    return F.when((long >= least) & (long - short >= margin), "LONG").when((short >= least) & (short - long >= margin), "SHORT").otherwise("NONE")


def calibration_error(p: Column, y: Column, bins: int = 10) -> tuple[Column, Column, Column]:
    """The bin (the last one closed), and the predicted and observed sums to add up in it."""
    edges = [i / bins for i in range(1, bins)]
    return sum((F.when(p >= e, 1).otherwise(0) for e in edges), F.lit(0)), p, y


def expected_calibration_error(rows: DataFrame, p: str, y: str, *keys: str, bins: int = 10) -> DataFrame:
    """Per key: rows, Brier score, the base rate's Brier score, accuracy, and the calibration error over equal bins."""
    b, _, _ = calibration_error(F.col(p), F.col(y), bins)
    rate = rows.groupBy(*keys).agg(F.avg(y).alias("_r")) if keys else rows.agg(F.avg(y).alias("_r"))
    r = rows.withColumn("_b", b)
    r = r.join(rate, list(keys)) if keys else r.crossJoin(F.broadcast(rate))
    g = r.groupBy(*keys, "_b").agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("sq"), F.sum(F.pow(F.col("_r") - F.col(y), 2)).alias("sb"), F.sum((F.when(F.col(p) >= 0.5, 1).otherwise(0) == F.col(y)).cast("int")).alias("ok"))
    out = g.groupBy(*keys) if keys else g.groupBy()
    return out.agg(F.sum("n").alias("n"), (F.sum("sq") / F.sum("n")).alias("brier"), (F.sum("sb") / F.sum("n")).alias("base_brier"), (F.sum("ok") / F.sum("n")).alias("accuracy"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("ece"))


def block_length(rows: DataFrame, horizon: int, *keys: str) -> DataFrame:
    """At least a day, and twice the label's horizon in median steps."""
    w = Window.partitionBy(*keys).orderBy("open_time_ms")
    d = rows.withColumn("d", F.col("open_time_ms") - F.lag("open_time_ms").over(w)).where("d > 0")
    return d.groupBy(*keys).agg(F.greatest(F.lit(DAY), (2 * horizon * F.percentile("d", 0.5)).cast("long")).alias("block_ms"))


def research_gate(trades: DataFrame, *keys: str, models: int = 6, least: int = 100, accuracy: float = 0.53, edge: float = 0.0, least_blocks: int = 12) -> DataFrame:
    """Signals (block, p, correct, net, touch) to measures and the ordered reasons that speak against them; the money reasons exclude
    each other."""
    g = trades.groupBy(*keys).agg(F.count("*").alias("signals"), F.sum("correct").alias("hits"), F.avg("net").alias("net_edge"), F.count_distinct("block").alias("blocks"), F.avg(F.col("touch").isin("UP", "DOWN", "BOTH").cast("double")).alias("resolved"), F.avg((F.col("touch") == "BOTH").cast("double")).alias("ambiguous"))
    low, high = wilson(F.col("hits"), F.col("signals"))
    flow, _ = wilson(F.col("hits"), F.col("signals"), bonferroni_z(models))
    g = g.withColumns({"accuracy": F.col("hits") / F.col("signals"), "low": low, "high": high, "family_low": flow})
    money = F.when(F.col("net_edge") <= edge, "edge").when(F.col("blocks") < least_blocks, "blocks")
    reasons = F.array_compact(F.array(F.when(F.col("signals") < least, "signals"), F.when(F.col("accuracy") < accuracy, "accuracy"), F.when(F.col("family_low") <= 0.5, "family"), money))
    return g.withColumn("reasons", F.array_join(reasons, ",")).withColumn("passed", F.size(reasons) == 0)


def purged(rows: DataFrame, cut_ms: Column, signal: str, exit_: str) -> DataFrame:
    """``segment``: train before the cut, test from it on, purged where the trade spans it."""
    return rows.withColumn("segment", F.when(F.col(exit_) < cut_ms, "train").when(F.col(signal) < cut_ms, "purged").otherwise("test"))


def final_split(rows: DataFrame, embargo: int, share: float = 0.9) -> DataFrame:
    """``role`` of each row of a series: the first share trains, an embargo, and the tail calibrates."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    r = rows.withColumns({"_i": F.row_number().over(Window.partitionBy("symbol").orderBy("open_time_ms")) - 1, "_n": n}).withColumn("_c", F.floor(F.col("_n") * share))
    return r.withColumn("role", F.when(F.col("_i") < F.col("_c"), "train").when(F.col("_i") >= F.col("_c") + embargo, "calibration").otherwise("embargo")).drop("_i", "_n", "_c")


def every_nth(rows: DataFrame, n: int) -> DataFrame:
    """Rows 0, n, 2n ... of each series: outcome windows of n rows do not overlap."""
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy("symbol").orderBy("open_time_ms")) - 1).where(F.col("_i") % n == 0).drop("_i")


def weekly_selector(trades: DataFrame, weeks: int = 4, least: int = 50, least_days: int = 10, edge: float = 20.0) -> DataFrame:
    """For each week the variant to trade: trained on the four weeks before (trades settled before the week begins), with enough
    trades and days and a mean above the edge; best mean, then name. One row for each week, null if none is eligible."""
    r = trades.withColumn("week", F.floor(F.col("signal_ms") / (7 * DAY)).cast("long"))
    for_weeks = r.withColumn("target", F.explode(F.sequence(F.col("week") + 1, F.col("week") + weeks))).where(F.col("exit_ms") < F.col("target") * 7 * DAY)
    g = for_weeks.groupBy("target", "variant").agg(F.count("*").alias("n"), F.count_distinct(F.floor(F.col("signal_ms") / DAY)).alias("days"), F.avg("net").alias("mean_net"))
    w = Window.partitionBy("target").orderBy(F.desc("mean_net"), "variant")
    best = g.where((F.col("n") >= least) & (F.col("days") >= least_days) & (F.col("mean_net") > edge)).withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("target").alias("week"), "variant", "n", "mean_net")
    return r.select("week").distinct().join(best, "week", "left")


def daily_refits(rows: DataFrame, least: int, held_out: Column) -> DataFrame:
    """An expanding refit for each day: rows that train (settled before the day, not of the held-out cohort) and rows it scores."""
    r = rows.withColumns({"day": F.floor(F.col("signal_ms") / DAY).cast("long"), "done": F.floor(F.col("exit_ms") / DAY).cast("long"), "held": held_out})
    ends = r.where(~F.col("held")).groupBy(F.col("done").alias("day")).agg(F.count("*").alias("new"))
    days = r.groupBy("day").agg(F.count("*").alias("scored"), F.count_if("held").alias("held_out"))
    # one row for each day: a single ordered series
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    j = days.join(ends, "day", "full").withColumn("train", F.coalesce(F.sum("new").over(w), F.lit(0)))
    return j.where(F.col("scored").isNotNull()).select("day", "train", "scored", "held_out", (F.col("train") >= least).alias("fitted"))


def point_in_time(items: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """What was known at each item's time: count, wins and mean of the rows of its key that had settled before it. Rows and items
    are put in one series and read by a running window: no range join."""
    a = rows.select(*keys, F.col("settled_ms").alias("t"), F.lit(1).alias("kind"), "net", F.lit(None).cast("long").alias("id"))
    b = items.select(*keys, F.col("bar_ms").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("net"), "id")
    w = Window.partitionBy(*keys).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, -1)
    u = a.unionByName(b).withColumns({"n": F.count("net").over(w), "wins": F.count_if(F.col("net") > 0).over(w), "total": F.coalesce(F.sum("net").over(w), F.lit(0.0))})
    return u.where("kind = 0").select("id", "n", "wins", ratio(F.col("total"), F.col("n").cast("double")).alias("mean_net"))


def touch_lift(rows: DataFrame, levels: tuple[float, ...], p: str = "p") -> DataFrame:
    """Classifier against always-yes by level: recall, false alerts, missed hits, Brier score and the base rate's."""
    r = rows.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels]))).withColumn("hit", (F.col("move") >= F.col("level")).cast("int")).withColumn("called", F.col(p) >= 0.5)
    base = F.avg("hit")  # hits are 0 or 1, so the base rate's mean squared error is base (1 - base): no row needs the others
    return r.groupBy("level").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), (F.count_if(F.col("called") & (F.col("hit") == 1)) / F.nullif(F.sum("hit"), F.lit(0))).alias("recall"), F.count_if(F.col("called") & (F.col("hit") == 0)).alias("false_alerts"), F.count_if(~F.col("called") & (F.col("hit") == 1)).alias("missed"),
                                 F.avg(F.pow(F.col(p) - F.col("hit"), 2)).alias("brier"), (base * (1 - base)).alias("base_brier"))


def side_lift(rows: DataFrame, p: str = "p") -> DataFrame:
    """A directional classifier by level against its unfiltered self and against always taking one side.

    ``rows``: level, side (LONG or SHORT), selected, p and base_p (of the side), hit_long and hit_short (0, 1; null while open). Out, of the settled rows: n, hits of the chosen
    side, selected and its hits with Wilson bounds, false alerts, missed hits, recall, always_long and always_short rates, Brier scores of p and base_p.
    """
    hit = F.when(F.col("side") == "LONG", F.col("hit_long")).otherwise(F.col("hit_short"))
    r = rows.withColumn("hit", hit).where("hit_long is not null and hit_short is not null")
    chosen = F.col("selected")
    g = r.groupBy("level").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.count_if(chosen).alias("selected"), F.count_if(chosen & (F.col("hit") == 1)).alias("selected_hits"), F.count_if(chosen & (F.col("hit") == 0)).alias("false_alerts"), F.count_if(~chosen & (F.col("hit") == 1)).alias("missed"),
                               F.avg("hit_long").alias("always_long"), F.avg("hit_short").alias("always_short"), F.avg(F.pow(F.col(p) - F.col("hit"), 2)).alias("brier"), F.avg(F.pow(F.col("base_p") - F.col("hit"), 2)).alias("base_brier"))
    low, high = wilson(F.col("selected_hits"), F.col("selected"))
    return g.withColumns({"recall": F.col("selected_hits") / F.nullif("hits", F.lit(0)), "low": low, "high": high})
