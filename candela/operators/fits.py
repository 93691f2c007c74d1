"""Many logistic models fitted side by side: grouped Newton steps on summed normal equations, and a refit for every day.

A step needs, for each model, only the sums of x (p - y) and w x x' over its rows. Tasks add them up for all models
whose rows they hold, Spark adds the tasks' sums, and each model's small system is solved. So rows stay where they are, a model's
rows are never gathered, and a model with most of the rows costs one sum from each task like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.scalars import sigmoid, wilson
from candela.sources.files import kept

DAY = 86_400_000
#: A model's rate is kept inside these bounds where only one label is seen.
RATE = (1e-4, 1 - 1e-4)


def _parts(x: np.ndarray, n: np.ndarray, hits: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """For each row of ``x``, seen ``n`` times with ``hits`` ones: its count and its parts of gradient and Hessian of the log loss at its own
    ``beta`` (intercept first)."""
    design = np.column_stack([np.ones(len(x)), x])
    p = 1 / (1 + np.exp(-np.clip((design * beta).sum(axis=1), -35, 35)))
    w = np.maximum(p * (1 - p), 1e-6) * n
    return np.column_stack([n, design * (n * p - hits)[:, None], (design[:, :, None] * design[:, None, :] * w[:, None, None]).reshape(len(x), -1)])


def _codes(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's key, and for each number a row that has it."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        d = c.dictionary_encode()
        code = np.unique(code * (len(d.dictionary) + 1) + np.asarray(d.indices.fill_null(len(d.dictionary)), np.int64), return_inverse=True)[1]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def _grid(x: np.ndarray, n: np.ndarray, hits: np.ndarray, mean: np.ndarray, spread: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Counts, gradients and Hessians of many models (in rows) over distinct rows ``x``, each seen n[i, k] times with hits[i, k] ones by model k."""
    d = beta.shape[1]
    design = np.ones((d, *n.shape))
    design[1:] = np.clip((x.T[:, :, None] - mean.T[:, None, :]) / spread.T[:, None, :], -8, 8)
    p = 1 / (1 + np.exp(-np.clip((design * beta.T[:, None, :]).sum(axis=0), -35, 35)))
    w, e = np.maximum(p * (1 - p), 1e-6) * n, p * n - hits
    return np.column_stack([n.sum(axis=0), *((e * design[i]).sum(axis=0) for i in range(d)), *((w * design[i] * design[j]).sum(axis=0) for i in range(d) for j in range(d))])


#: The largest change of a coefficient in one step. Unbounded steps run away where nearly all labels are one.
STRIDE = 1.0


def _stepped(sums: np.ndarray, beta: np.ndarray, l2: float) -> np.ndarray:
    """Newton's next ``beta`` for models in rows, a step being shortened to ``STRIDE``; the intercept is not penalised."""
    d = beta.shape[1]
    penalty = np.r_[0.0, np.full(d - 1, l2)]
    gradient = sums[:, 1 : d + 1] + penalty * beta
    hessian = sums[:, d + 1 :].reshape(-1, d, d) + np.diag(penalty + 1e-12)
    step = np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0]
    return beta - step * np.minimum(1.0, STRIDE / np.maximum(np.abs(step).max(axis=1, keepdims=True), 1e-300))


def logistic_fits(rows: DataFrame, keys: tuple[str, ...], features: tuple[str, ...], target: str, l2: float = 1.0, steps: int = 60, tol: float = 1e-7) -> DataFrame:
    """``keys``, n, intercept, weights (array), moved: for each key the minimum of the summed log loss plus l2/2 times the squared weights.

    Rows with a null feature or target do not count. Equal rows are merged first and count as often as they come. Every step is one
    pass over the rows of the models that still move, whose coefficients meet them by a join on the keys; ``moved`` is the last step's
    largest change.
    """
    d = len(features) + 1
    x = F.array(*[F.col(c).cast("double") for c in features])
    data = rows.dropna(subset=[*features, target]).select(*keys, x.alias("_x"), F.col(target).cast("double").alias("_y"))
    data = kept(data.groupBy(*keys, "_x").agg(F.count("*").cast("double").alias("_n"), F.sum("_y").alias("_h")), "fit-rows")
    rate = F.least(F.lit(RATE[1]), F.greatest(F.lit(RATE[0]), F.sum("_h") / F.sum("_n")))
    state = data.groupBy(*keys).agg(F.log(rate / (1 - rate)).alias("_a"), F.lit(float("inf")).alias("moved"), F.sum("_n").cast("long").alias("n"))
    state = kept(state.select(*keys, F.concat(F.array("_a"), F.array_repeat(F.lit(0.0), d - 1)).alias("_beta"), "moved", "n"), "fit-state")
    of_keys = [data.schema[k] for k in keys]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            code, first = _codes([batch.column(c) for c in keys])
            flat = lambda c, n: np.asarray(batch.column(c).flatten()).reshape(-1, n)
            parts = _parts(flat("_x", d - 1), batch.column("_n").to_numpy(), batch.column("_h").to_numpy(), flat("_beta", d))
            order = np.argsort(code, kind="stable")
            made = np.add.reduceat(parts[order], np.searchsorted(code[order], np.arange(len(first))), axis=0)
            for k, own in zip(zip(*(batch.column(c).take(pa.array(first)).to_pylist() for c in keys)), made):
                total[k] = total[k] + own if k in total else own
            if len(total) > 20_000:  # what a task holds stays bounded
                yield out(total)
                total = {}
        yield out(total)

    def out(total: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        cols = list(zip(*total)) if total else [()] * len(keys)
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds)), pa.array(list(total.values()), pa.list_(pa.float64()))], names=[*keys, "_s"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in of_keys]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in of_keys)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = lambda c, n: np.asarray(batch.column(c).flatten()).reshape(-1, n)
            beta = flat("_beta", d)
            new = _stepped(flat("_s", 1 + d + d * d), beta, l2) if len(beta) else beta
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(list(new), pa.list_(pa.float64())), pa.array(np.abs(new - beta).max(axis=1, initial=0.0)), batch.column("n")], names=[*keys, "_beta", "moved", "n"])

    for _ in range(steps):
        open_ = state.where(F.col("moved") >= tol)
        if open_.isEmpty():
            break
        sums = data.join(open_.select(*keys, "_beta"), list(keys)).mapInArrow(add, f"{ddl}, _s array<double>")
        size = 1 + d + d * d
        sums = sums.groupBy(*keys).agg(*[F.sum(F.get("_s", F.lit(i))).alias(f"_{i}") for i in range(size)]).select(*keys, F.array(*[f"_{i}" for i in range(size)]).alias("_s"))
        new = sums.join(open_.drop("moved"), list(keys)).mapInArrow(solve, f"{ddl}, _beta array<double>, moved double, n long")
        state = kept(new.unionByName(state.where(F.col("moved") < tol)), "fit-state")
    return state.select(*keys, "n", F.get("_beta", F.lit(0)).alias("intercept"), F.slice("_beta", 2, d - 1).alias("weights"), "moved")


def platt_fits(rows: DataFrame, keys: tuple[str, ...], logit: str, target: str) -> DataFrame:
    """``keys``, slope, base: each key's calibration of ``logit`` (slope penalty 0.01). One label only, no spread, or a negative
    slope: slope 0 and the base rate's logit."""
    y = F.col(target).cast("double")
    rate = F.least(F.lit(RATE[1]), F.greatest(F.lit(RATE[0]), F.avg(y)))
    flat = rows.groupBy(*keys).agg(F.log(rate / (1 - rate)).alias("_flat"), ((F.min(y) == F.max(y)) | (F.stddev_pop(logit) < 1e-9)).alias("_one"))
    fit = logistic_fits(rows, keys, (logit,), target, 0.01).withColumn("_w", F.get("weights", F.lit(0)))
    bad = F.col("_one") | (F.col("_w") < 0) | F.col("_w").isNull()
    return flat.join(fit, list(keys), "left").select(*keys, F.when(bad, 0.0).otherwise(F.col("_w")).alias("slope"), F.when(bad, F.col("_flat")).otherwise(F.col("intercept")).alias("base"))


def scales(rows: DataFrame, keys: tuple[str, ...], features: tuple[str, ...]) -> DataFrame:
    """``keys`` and for each feature its mean and population deviation (one if below 1e-9), as arrays ``_m`` and ``_d``."""
    g = rows.groupBy(*keys).agg(*[f(c).alias(f"_{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("d", F.stddev_pop))])
    return g.select(*keys, F.array(*[f"_m{i}" for i in range(len(features))]).alias("_m"), F.array(*[F.when(F.col(f"_d{i}") < 1e-9, 1.0).otherwise(F.col(f"_d{i}")) for i in range(len(features))]).alias("_d"))


def with_scales(rows: DataFrame, table: DataFrame, keys: tuple[str, ...], features: tuple[str, ...], clip: float = 8.0) -> DataFrame:
    """Features in deviations from their key's mean, clipped."""
    z = {c: F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(c) - F.get("_m", F.lit(i))) / F.get("_d", F.lit(i)))) for i, c in enumerate(features)}
    return rows.join(table, list(keys)).withColumns(z).drop("_m", "_d")


def dot(features: tuple[str, ...]) -> Column:
    """``intercept`` plus ``weights`` times the features."""
    return sum((F.col(c) * F.get("weights", F.lit(i)) for i, c in enumerate(features)), F.col("intercept"))


def model_roles(rows: DataFrame, keys: tuple[str, ...], order: str, horizon: str, share: float = 0.15, least_test: int = 120, least_train: int = 500) -> DataFrame:
    """The rows of each series once for each of two fits, with ``fit``, ``role`` and ``disjoint``.

    ``test``: training, an embargo of one horizon, calibration, an embargo, and the last ``share`` of the rows to test; ``live``:
    training, an embargo and the last rows to calibrate. ``disjoint`` marks the test rows whose outcome windows do not overlap.
    Series too short for both give no rows; neither do embargoed ones.
    """
    w = Window.partitionBy(*keys)
    r = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    size, h, i = F.greatest(F.lit(least_test), F.floor(F.col("_n") * share)).cast("long"), F.col(horizon), F.col("_i")
    r = r.withColumn("_k", size).withColumns({"_test": F.col("_n") - F.col("_k"), "_cal": F.col("_n") - 2 * F.col("_k") - h})
    r = r.where((F.col("_cal") - h >= least_train) & (F.col("_test") < F.col("_n")))
    test = F.when(i < F.col("_cal") - h, "train").when((i >= F.col("_cal")) & (i < F.col("_test") - h), "calibration").when(i >= F.col("_test"), "test")
    live = F.when(i < F.col("_test") - h, "train").when(i >= F.col("_test"), "calibration")
    both = F.explode(F.array(F.struct(F.lit("test").alias("fit"), test.alias("role")), F.struct(F.lit("live").alias("fit"), live.alias("role"))))
    r = r.withColumn("_f", both).withColumns({"fit": F.col("_f.fit"), "role": F.col("_f.role")}).where("role is not null")
    return r.withColumn("disjoint", (F.col("role") == "test") & ((i - F.col("_test")) % h == 0)).drop("_i", "_n", "_k", "_test", "_cal", "_f")


def series_models(rows: DataFrame, newest: DataFrame, keys: tuple[str, ...], features: tuple[str, ...], order: str = "open_time_ms", horizon: str = "horizon", **limits) -> DataFrame:
    """One row for each series (``keys``): a model of its own, calibrated, judged on later rows that do not overlap, then fitted anew on all
    history for its newest row.

    ``rows`` need features, target (0 or 1), long_net and short_net, and ``horizon`` in rows; ``newest`` holds the features to score by series.
    Out: test_count, accuracy with its Wilson bounds, brier, base_brier (the test rows' own rate), mean_net of the side chosen,
    probability_up of the newest row, and the live model's training rows and coefficients.
    """
    own = (*keys, "fit")
    r = kept(model_roles(rows, keys, order, horizon, **limits).select(*own, "role", "disjoint", "target", "long_net", "short_net", *features), "model-rows")
    train = F.col("role") == "train"
    table = kept(scales(r.where(train), own, features), "model-scales")
    z = kept(with_scales(r, table, own, features), "model-rows")
    fit = logistic_fits(z.where(train), own, features, "target")
    z = z.where(~train).join(fit, list(own)).withColumn("logit", dot(features))
    platt = kept(platt_fits(z.where("role = 'calibration'"), own, "logit", "target"), "model-platt")
    test = z.where("role = 'test'").join(platt, list(own)).withColumn("p", sigmoid(F.col("logit") * F.col("slope") + F.col("base")))
    up = F.col("p") >= 0.5
    rate = test.groupBy(*keys).agg(F.avg("target").alias("_rate"))
    judged = test.where("disjoint").join(rate, list(keys)).groupBy(*keys).agg(
        F.count("*").alias("test_count"), F.count_if(up == (F.col("target") == 1)).alias("_ok"), F.avg(F.pow(F.col("p") - F.col("target"), 2)).alias("brier"), F.avg(F.pow(F.col("_rate") - F.col("target"), 2)).alias("base_brier"),
        F.avg(F.when(up, F.col("long_net")).otherwise(F.col("short_net"))).alias("mean_net"))
    low, high = wilson(F.col("_ok"), F.col("test_count"))
    judged = judged.withColumns({"accuracy": F.col("_ok") / F.col("test_count"), "low": low, "high": high})
    live = F.col("fit") == "live"
    now = with_scales(newest.select(*keys, *features), table.where(live).drop("fit"), keys, features).join(fit.where(live).drop("fit"), list(keys)).join(platt.where(live).drop("fit"), list(keys))
    now = now.select(*keys, sigmoid(dot(features) * F.col("slope") + F.col("base")).alias("probability_up"), F.col("n").alias("live_train"), "intercept", "weights", "slope", F.col("base").alias("offset"))
    return judged.drop("_ok").join(now, list(keys))


def _quantile(rows: DataFrame, keys: tuple[str, ...], c: str, share: float, to: str) -> DataFrame:
    """``keys``, ``to``: the quantile of ``c`` by key. Equal values are counted first, so that a key's task gets each value once."""
    counts = rows.groupBy(*keys, c).agg(F.count("*").alias("_f"))
    return counts.groupBy(*keys).agg(F.percentile(c, share, F.col("_f")).alias(to))


def ranked(rows: DataFrame, keys: tuple[str, ...], features: tuple[str, ...], target: str, l2: float = 10.0, share: float = 0.8) -> DataFrame:
    """The test rows of each fold (``keys``) with ``score``, ``threshold`` and ``selected``.

    ``rows`` carry ``role`` (train, calibration, test). Nulls take the training rows' medians, features their scale; a logistic model is fitted on the
    training rows, and the calibration rows' quantile ``share`` of its score is the threshold. Nothing is learned from test rows.
    """
    train = F.col("role") == "train"
    medians = rows.where(train).select(*keys).distinct()
    for i, c in enumerate(features):
        medians = medians.join(_quantile(rows.where(train), keys, c, 0.5, f"_q{i}"), list(keys))
    medians = kept(medians, "ranked-medians")  # its size is known, so the rows stay where they are
    r = rows.join(medians, list(keys)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_q{i}"), F.lit(0.0)) for i, c in enumerate(features)}).select(*rows.columns)
    r = kept(r, "ranked-rows")
    z = kept(with_scales(r, kept(scales(r.where(train), keys, features), "ranked-scales"), keys, features), "ranked-rows")
    s = z.where(~train).join(logistic_fits(z.where(train), keys, features, target, l2).drop("n", "moved"), list(keys)).withColumn("score", dot(features)).drop("intercept", "weights")
    cut = kept(_quantile(s.where("role = 'calibration'"), keys, "score", share, "threshold"), "ranked-cuts")
    return s.where("role = 'test'").join(cut, list(keys)).withColumn("selected", F.col("score") >= F.col("threshold"))


def bundles(fits: DataFrame, table: DataFrame, platt: DataFrame, keys: tuple[str, ...], features: tuple[str, ...], version: int, trained_ms: Column) -> DataFrame:
    """Models as rows that can be saved: keys, version, features, means, deviations, intercept, weights, slope, offset, trained_ms."""
    names = F.array(*[F.lit(c) for c in features])
    return fits.join(table, list(keys)).join(platt, list(keys)).select(*keys, F.lit(version).alias("version"), names.alias("features"), F.col("_m").alias("means"), F.col("_d").alias("deviations"), "intercept", "weights", "slope", F.col("base").alias("offset"), trained_ms.alias("trained_ms"))


def bundle_scores(newest: DataFrame, saved: DataFrame, keys: tuple[str, ...], features: tuple[str, ...], version: int, price: str = "close", move_bps: str = "barrier_bps") -> DataFrame:
    """The newest rows (keys, features, price, move) scored by saved models of that version whose numbers are all finite: keys, probability, direction, confidence, the price
    range that the move spans, and the features' contributions, largest first."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    numbers = F.concat("means", "deviations", "weights", F.array("intercept", "slope", "offset"))
    whole = F.forall(numbers, finite) & F.forall("deviations", lambda x: x > 0)
    names = F.array(*[F.lit(c) for c in features])
    ok = saved.where((F.col("version") == version) & (F.col("features") == names) & (F.size("weights") == len(features)) & whole)
    r = newest.join(ok, list(keys))
    part = lambda i, c: F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col(c) - F.get("means", F.lit(i))) / F.get("deviations", F.lit(i)))) * F.get("weights", F.lit(i)) * F.col("slope")
    r = r.withColumns({f"_c{i}": part(i, c) for i, c in enumerate(features)})
    p = sigmoid(sum((F.col(f"_c{i}") for i in range(len(features))), F.col("intercept") * F.col("slope") + F.col("offset")))
    order = F.array_sort(F.array(*[F.struct((-F.abs(F.col(f"_c{i}"))).alias("v"), F.lit(c).alias("k")) for i, c in enumerate(features)]))
    r = r.withColumn("probability", p)
    move = F.col(move_bps) / 10_000
    return r.select(*keys, "probability", F.when(F.col("probability") >= 0.5, "UP").otherwise("DOWN").alias("direction"), F.greatest("probability", 1 - F.col("probability")).alias("confidence"), (F.col(price) * F.exp(-move)).alias("low_price"),
                    (F.col(price) * F.exp(move)).alias("high_price"), F.array_join(F.transform(order, lambda x: x.k), ",").alias("contributions"))


def _bounds(day: int, calibration: int) -> tuple[int, int, int]:
    """Last day that trains, first and last that calibrate, for a model of ``day``: outcomes take at most a day, which is purged on
    both sides of the calibration days."""
    return day - calibration - 3, day - calibration - 1, day - 2


def expanding_refits(rows: DataFrame, features: tuple[str, ...], l2: float = 10.0, calibration: int = 5, least_train: int = 150, least_calibration: int = 60, least_class: tuple[int, int] = (10, 5), steps: int = 60, tol: float = 1e-7) -> DataFrame:
    """A model for every day that has rows, fitted on all rows settled before it, calibrated on the five days before, scoring that day.

    ``rows``: id, t (ms), held (never trains nor calibrates), target (null: not settled, only scored) and features without nulls. Out: id, day,
    train, calibration (rows), status, base_rate (of the calibration rows, (hits + 1) / (n + 2)), probability.

    Scales come from running sums of days. Rows of equal features are one, with its counts by day. A task holds the models of all days (a few
    numbers each) and adds up every day's normal equations over its own rows, each as often as it had come by then; the driver sees
    one small system for each calendar day. So a step costs distinct rows times days, however often a row comes.
    """
    d = len(features) + 1
    x = F.array(*[F.col(c).cast("double") for c in features])
    data = kept(rows.select("id", F.floor(F.col("t") / DAY).cast("long").alias("day"), "held", F.col("target").cast("double").alias("y"), x.alias("x")), "refit-rows")
    may = data.where(~F.col("held") & F.col("y").isNotNull())
    daily = may.groupBy("day").agg(F.count("*").alias("n"), F.sum("y").alias("hits"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(d - 1)], *[F.sum(F.pow(F.get("x", F.lit(i)), 2)).alias(f"q{i}") for i in range(d - 1)])
    sums = {r["day"]: np.array(r[1:], float) for r in daily.collect()}  # one row for each calendar day
    scored = sorted(r["day"] for r in data.select("day").distinct().collect())
    if not scored:
        return rows.sparkSession.createDataFrame([], "id long, day long, train long, calibration long, status string, base_rate double, probability double")
    first, last = min(scored), max(scored)
    run = np.zeros((last - first + 2, 2 * d))
    for day, s in sums.items():
        run[day - first + 1] = s
    run = run.cumsum(axis=0)  # run[k]: sums of the days before first + k
    upto = lambda day: run[np.clip(day - first + 1, 0, len(run) - 1)]  # noqa: E731  days up to and with ``day``
    folds = []
    for day in scored:
        end, lo, hi = _bounds(day, calibration)
        folds.append((day, *upto(end)[:2], *(upto(hi) - upto(lo - 1))[:2], upto(end)))
    rare = lambda n, hits: min(hits, n - hits)
    status = {}
    for day, n, hits, m, cal_hits, _ in folds:
        status[day] = "insufficient_history" if n < least_train or m < least_calibration else "insufficient_classes" if rare(n, hits) < least_class[0] or rare(m, cal_hits) < least_class[1] else "fitted"
    fitted = [f for f in folds if status[f[0]] == "fitted"]
    days = np.array([f[0] for f in fitted], np.int64)
    whole = np.array([f[5] for f in fitted]).reshape(-1, 2 * d)
    n = np.maximum(whole[:, :1], 1)
    mean = whole[:, 2 : d + 1] / n
    spread = np.sqrt(np.maximum(whole[:, d + 1 :] / n - mean**2, 0))
    spread = np.where(spread < 1e-9, 1.0, spread)
    rate = np.clip(whole[:, 1] / n[:, 0], *RATE)
    beta = np.column_stack([np.log(rate / (1 - rate)), np.zeros((len(days), d - 1))])
    spark, open_ = rows.sparkSession, np.arange(len(days))
    counted = may.groupBy("x", "day").agg(F.count("*").alias("n"), F.sum("y").alias("h")).groupBy("x").agg(F.collect_list(F.struct("day", "n", "h")).alias("c"))  # an entry for each day at most
    counted = kept(counted.select("x", *[F.col(f"c.{c}").cast("array<double>").alias(c) for c in ("day", "n", "h")]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "refit-counts")
    for _ in range(steps):
        if not len(open_):
            break
        held = spark.sparkContext.broadcast((_bounds(days[open_], calibration)[0], mean[open_], spread[open_], beta[open_]))  # a few numbers for each calendar day

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ends, m, s, b = held.value
            total = np.zeros((len(ends), 1 + d + d * d))
            some = max(1, 500_000 // len(ends))  # rows whose counts by model are held at once
            for batch in (whole.slice(i, some) for whole in batches for i in range(0, whole.num_rows, some)):
                xs = np.asarray(batch.column("x").flatten()).reshape(-1, d - 1)
                row = np.repeat(np.arange(len(xs)), batch.column("day").value_lengths().to_numpy())
                fold = np.searchsorted(ends, np.asarray(batch.column("day").flatten()))  # the first model that knows the day
                at, size = (row * (len(ends) + 1) + fold), len(xs) * (len(ends) + 1)
                n, h = (np.bincount(at, np.asarray(batch.column(c).flatten()), size).reshape(len(xs), -1)[:, :-1].cumsum(axis=1) for c in ("n", "h"))
                total += _grid(xs, n, h, m, s, b)
            some = np.flatnonzero(total[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["k", "s"])

        parts = counted.mapInArrow(add, "k long, s array<double>")
        size = 1 + d + d * d
        got = sorted(parts.groupBy("k").agg(*[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(size)]).collect())
        k = np.array([r["k"] for r in got], np.int64)
        new = _stepped(np.array([r[1:] for r in got], float), beta[open_[k]], l2)
        moved = np.abs(new - beta[open_[k]]).max(axis=1)
        beta[open_[k]] = new
        open_ = open_[k[moved >= tol]]
    models = spark.createDataFrame([(int(day), m.tolist(), s.tolist(), float(b[0]), b[1:].tolist()) for day, m, s, b in zip(days, mean, spread, beta)], "day long, _m array<double>, _d array<double>, intercept double, weights array<double>")
    z = lambda i: F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.get("x", F.lit(i)) - F.get("_m", F.lit(i))) / F.get("_d", F.lit(i))))
    logit = sum((z(i) * F.get("weights", F.lit(i)) for i in range(d - 1)), F.col("intercept"))
    cal = may.withColumn("day", F.explode(F.sequence(F.col("day") + 2, F.col("day") + calibration + 1)))  # the days that a row calibrates
    cal = cal.join(models, "day").select("day", "y", logit.alias("logit"))
    table = spark.createDataFrame([(day, int(n), int(m), status[day], float((hits + 1) / (m + 2))) for day, n, _, m, hits, _ in folds], "day long, train long, calibration long, status string, base_rate double")
    one = data.select("id", "day", "x").join(table, "day").join(models, "day", "left").join(platt_fits(cal, ("day",), "logit", "y"), "day", "left")
    p = F.when(F.col("status") == "fitted", sigmoid(logit * F.col("slope") + F.col("base"))).when(F.col("status") == "insufficient_classes", F.col("base_rate"))
    state = F.when(F.col("status") == "fitted", F.when(F.col("slope") > 0, "calibrated").otherwise("calibration_failed")).otherwise(F.col("status"))
    return one.select("id", "day", "train", "calibration", state.alias("status"), "base_rate", p.alias("probability"))
