"""Grouped fits, daily refits, chunked folds and selectors against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.operators import fits, folds, ledgers, selectors

DAY = 86_400_000


def newton(x, y, l2, steps=80):
    """A plain logistic fit; intercept first, not penalised."""
    a = np.column_stack([np.ones(len(x)), x])
    rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
    b = np.r_[math.log(rate / (1 - rate)), np.zeros(x.shape[1])]
    ridge = np.diag(np.r_[0.0, np.full(x.shape[1], l2)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -35, 35)))
        w = np.maximum(p * (1 - p), 1e-6)
        d = np.linalg.solve(a.T @ (a * w[:, None]) + ridge + 1e-12 * np.eye(len(b)), a.T @ (p - y) + ridge @ b)
        b = b - d
        if abs(d).max() < 1e-9:
            break
    return b


def platt(logit, y):
    rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
    flat = (0.0, math.log(rate / (1 - rate)))
    if len(set(y)) < 2 or logit.std() < 1e-9:
        return flat
    base, slope = newton(logit[:, None], y, 0.01)
    return flat if slope < 0 else (slope, base)


def test_fits_side_by_side(spark):
    """Models of unlike sizes, one of a single label, a null feature that does not count, and a null key."""
    r = np.random.default_rng(1)
    rows = []
    for k, h, n in (("a", 1, 300), ("a", 2, 40), ("b", 1, 2000), (None, 1, 60)):
        x = r.normal(size=(n, 3))
        y = (r.random(n) < 1 / (1 + np.exp(-(x @ [1.0, -0.5, 0.2] + 0.3)))).astype(int)
        rows += [(k, h, *map(float, v), int(t)) for v, t in zip(x, y)]
    rows += [("one", 1, float(i), float(i % 3), 1.0, 1) for i in range(20)] + [("a", 1, None, 0.0, 0.0, 1)]
    d = spark.createDataFrame(rows, "k string, h int, x0 double, x1 double, x2 double, y int")
    got = {(g.k, g.h): g for g in fits.logistic_fits(d.where("k is not null"), ("k", "h"), ("x0", "x1", "x2"), "y", 1.0).collect()}
    for key in (("a", 1), ("a", 2), ("b", 1)):
        own = [v for v in rows if v[:2] == key and None not in v]
        want = newton(np.array([v[2:5] for v in own]), np.array([v[5] for v in own], float), 1.0)
        assert got[key].n == len(own) and got[key].moved < 1e-7
        assert [got[key].intercept, *got[key].weights] == pytest.approx(list(want), abs=1e-6)
    assert max(map(abs, got["one", 1].weights)) < 1e-3 and got["one", 1].intercept > 5
    assert fits.logistic_fits(d.where("k = 'none'"), ("k", "h"), ("x0", "x1", "x2"), "y").count() == 0


def test_calibrations(spark):
    r = random.Random(4)
    rows = [("up", v, int(r.random() < 1 / (1 + math.exp(-2 * v)))) for v in [r.gauss(0, 1) for _ in range(300)]]
    rows += [("down", v, int(r.random() < 1 / (1 + math.exp(2 * v)))) for v in [r.gauss(0, 1) for _ in range(300)]]
    rows += [("flat", 0.5, i % 2) for i in range(20)] + [("same", float(i), 1) for i in range(20)]
    got = {g.k: (g.slope, g.base) for g in fits.platt_fits(spark.createDataFrame(rows, "k string, l double, y int"), ("k",), "l", "y").collect()}
    for k in ("up", "down", "flat", "same"):
        own = [v for v in rows if v[0] == k]
        assert got[k] == pytest.approx(platt(np.array([v[1] for v in own]), np.array([v[2] for v in own], float)), abs=1e-6)
    assert got["down"][0] == 0 == got["flat"][0] and got["up"][0] > 1


def test_series_models_by_loops(spark):
    """All nine features' worth of columns, two horizons, and a series too short for a model."""
    r = np.random.default_rng(3)
    names = tuple(f"f{i}" for i in range(9))
    rows, newest = [], []
    for s, n in (("a", 900), ("b", 800), ("short", 300)):
        for h in (3, 20):
            x = r.normal(size=(n, 9)) * r.uniform(0.5, 3, 9)
            y = (r.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * x[:, 1])))).astype(int)
            rows += [(s, h, t, *map(float, v), int(u), float(5 * u - 3), float(2 - 5 * u)) for t, (v, u) in enumerate(zip(x, y))]
            newest.append((s, h, *map(float, r.normal(size=9))))
    cols = ", ".join(f"{c} double" for c in names)
    d = spark.createDataFrame(rows, f"symbol string, horizon int, open_time_ms long, {cols}, target int, long_net double, short_net double").repartition(5)
    got = {(g.symbol, g.horizon): g for g in fits.series_models(d, spark.createDataFrame(newest, f"symbol string, horizon int, {cols}"), ("symbol", "horizon"), names).collect()}
    assert set(got) == {(s, h) for s in "ab" for h in (3, 20)}
    for (s, h), g in got.items():
        own = [v for v in rows if v[:2] == (s, h)]
        x, y = np.array([v[3:12] for v in own]), np.array([v[12] for v in own], float)
        n = len(own)
        size = max(120, int(n * 0.15))
        test, cal = n - size, n - 2 * size - h
        def fitted(train, rest):
            m, sd = x[train].mean(0), x[train].std(0)
            z = lambda v: np.clip((v - m) / np.where(sd < 1e-9, 1, sd), -8, 8)
            b = newton(z(x[train]), y[train], 1.0)
            slope, base = platt(b[0] + z(x[rest]) @ b[1:], y[rest])
            return lambda v: 1 / (1 + np.exp(-(slope * (b[0] + z(v) @ b[1:]) + base)))
        p = fitted(slice(0, cal - h), slice(cal, test - h))(x[test::h])
        u = y[test::h]
        assert g.test_count == len(u) and g.accuracy == pytest.approx(np.mean((p >= 0.5) == (u == 1)))
        assert g.brier == pytest.approx(np.mean((p - u) ** 2), abs=1e-6) and g.base_brier == pytest.approx(np.mean((y[test:].mean() - u) ** 2))
        assert g.mean_net == pytest.approx(np.mean([v[13] if q >= 0.5 else v[14] for v, q in zip(own[test::h], p)]))
        now = np.array([v[2:] for v in newest if v[:2] == (s, h)])
        assert g.live_train == test - h and g.probability_up == pytest.approx(fitted(slice(0, test - h), slice(test, n))(now)[0], abs=1e-6)


def test_refits_by_fitting_every_day(spark):
    r = np.random.default_rng(5)
    rows = []
    for day in range(40):
        for _ in range(int(r.integers(2, 14)) if day % 11 else 0):  # days without rows
            x = r.normal(size=2)
            y = int(r.random() < 1 / (1 + math.exp(-(x[0] + 0.05 * day - 1)))) if r.random() > 0.1 else None
            rows.append((len(rows), (1000 + day) * DAY + int(r.integers(0, DAY)), bool(r.random() < 0.1), y, *map(float, x)))
    d = spark.createDataFrame(rows, "id long, t long, held boolean, target int, f0 double, f1 double").repartition(3)
    limits = {"least_train": 40, "least_calibration": 15, "least_class": (5, 3)}
    got = {g.id: g for g in fits.expanding_refits(d, ("f0", "f1"), **limits).collect()}
    assert len(got) == len(rows)
    seen = set()
    for i, t, _, _, *x in rows:
        day, g = t // DAY, got[i]
        may = [v for v in rows if not v[2] and v[3] is not None]
        train = [v for v in may if v[1] + DAY < (day - 6) * DAY]
        cal = [v for v in may if v[1] >= (day - 6) * DAY and v[1] + DAY < day * DAY]
        hits, cal_hits = sum(v[3] for v in train), sum(v[3] for v in cal)
        assert (g.day, g.train, g.calibration) == (day, len(train), len(cal)) and g.base_rate == pytest.approx((cal_hits + 1) / (len(cal) + 2))
        if len(train) < 40 or len(cal) < 15:
            want = ("insufficient_history", None)
        elif min(hits, len(train) - hits) < 5 or min(cal_hits, len(cal) - cal_hits) < 3:
            want = ("insufficient_classes", g.base_rate)
        else:
            xs, ys = np.array([v[4:] for v in train]), np.array([v[3] for v in train], float)
            z = lambda v: np.clip((np.asarray(v) - xs.mean(0)) / xs.std(0), -8, 8)
            b = newton(z(xs), ys, 10.0)
            slope, base = platt(b[0] + z([v[4:] for v in cal]) @ b[1:], np.array([v[3] for v in cal], float))
            want = ("calibrated" if slope > 0 else "calibration_failed", 1 / (1 + math.exp(-(slope * (b[0] + z(x) @ b[1:]) + base))))
        seen.add(want[0])
        assert g.status == want[0] and (g.probability is None) == (want[1] is None)
        if want[1] is not None:
            assert g.probability == pytest.approx(want[1], abs=1e-6)
    assert {"insufficient_history", "calibrated"} <= seen
    assert fits.expanding_refits(d.where("false"), ("f0", "f1")).count() == 0


def greedy(rows, cap, closed):
    open_, out = {}, []
    for i, s, t, u in rows:
        open_ = {k: v for k, v in open_.items() if v > t or closed and v == t}
        if s not in open_ and len(open_) < cap:
            open_[s] = u
            out.append(i)
    return out


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("bound", [1, 60, 100_000])
def test_capacity_on_dense_trades(spark, closed, bound):
    """Hourly trades of seven days: no gap to cut at. The chunks do not change the result, nor does a bound of one day."""
    r = random.Random(8)
    rows = [(k, i, f"s{r.randrange(9)}", t, t + r.randrange(1, 14 * 24) * 3_600_000) for k in ("x", "y") for i, t in enumerate(range(0, 400 * 3_600_000, 3_600_000))]
    d = spark.createDataFrame(rows, "key string, id long, symbol string, a long, b long").repartition(4)
    got = folds.capacity(d, ("key",), "id", "a", "b", [F.col("a"), F.col("symbol")], 3, closed=closed, bound=bound).collect()
    assert sorted(map(tuple, got)) == sorted((k, i) for k in ("x", "y") for i in greedy([v[1:] for v in rows if v[0] == k], 3, closed))


@pytest.mark.parametrize("bound", [1, 10_000])
def test_daily_cap_on_dense_rows(spark, bound):
    r = random.Random(9)
    rows = [("x", i, f"s{r.randrange(30)}", t, t + r.randrange(1, 200) * 3_600_000, r.random()) for i, t in enumerate(range(0, 900 * 1_800_000, 1_800_000))]
    d = spark.createDataFrame(rows, "key string, id long, symbol string, a long, b long, score double").repartition(3)
    got = folds.daily_capped(d, ("key",), "id", "a", "b", [F.col("a"), F.desc("score")], 3, bound=bound).collect()
    free, taken, want = {}, {}, []
    for _, i, s, t, u, _ in rows:
        if t >= free.get(s, t) and taken.get(t // DAY, 0) < 3:
            free[s], taken[t // DAY] = u, taken.get(t // DAY, 0) + 1
            want.append(i)
    assert sorted(g.id for g in got) == want
    assert folds.daily_capped(d.where("false"), ("key",), "id", "a", "b", [F.col("a")], 3).count() == 0


def test_block_interval_by_draws(spark):
    r = random.Random(2)
    rows = [("a", d, r.gauss(3, 10)) for d in range(30) for _ in range(r.randrange(1, 5))] + [("few", d, 1.0) for d in range(4)] + [("a", 3, None)]
    got = {g.k: g for g in selectors.block_means_ci(spark.createDataFrame(rows, "k string, d int, v double"), ("k",), F.col("d"), F.col("v")).collect()}
    days = sorted({d for k, d, v in rows if k == "a" and v is not None})
    sums = [(sum(v for k, e, v in rows if (k, e) == ("a", d) and v is not None), sum(1 for k, e, v in rows if (k, e) == ("a", d) and v is not None)) for d in days]
    a, b, c, p = selectors.HASH
    means = []
    for draw in range(200):
        picks = [sums[(draw * a + slot * b + 7 * c) % p * 48_271 % p % len(days)] for slot in range(len(days))]
        means.append(sum(s for s, _ in picks) / sum(n for _, n in picks))
    assert (got["a"].low, got["a"].high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975]))) and got["a"].blocks == 30
    assert got["few"].low is None and got["few"].blocks == 4


def test_percentiles_of_unseen_scores(spark):
    """Scores between and beyond past ones, a family with too few, ties, and the mean over families."""
    past = spark.createDataFrame([("A", "x", float(i)) for i in range(20)] + [("B", "x", 5.0)] * 10 + [("C", "x", 1.0)] * 9 + [("A", "x", None), ("A", "x", float("nan"))], "family string, regime string, score double")
    items = [(1, ["A"], "x", 5.0), (2, ["A"], "x", 5.5), (3, ["A"], "x", 99.0), (4, ["A"], "x", -1.0), (5, ["A", "B"], "x", 5.0), (6, ["C"], "x", 1.0), (7, ["A", "C"], "x", 0.0), (8, ["A"], "y", 1.0)]
    got = {g.id: g.percentile for g in ledgers.quality_percentiles(spark.createDataFrame(items, "id int, families array<string>, regime string, score double"), past).collect()}
    assert got == {1: 0.3, 2: 0.3, 3: 1.0, 4: 0.0, 5: 0.65, 6: None, 7: 0.05, 8: None}


def test_safety_without_a_limit_and_with_settled_alerts(spark):
    now = 100 * DAY + 3_600_000
    ledger = spark.createDataFrame([(True, now - 600_000, 60, now - 60_000, "TARGET", -5.0), (True, now - 600_000, 60, now + 3_000_000, None, None)], "notified boolean, bar_ms long, horizon int, settled_ms long, status string, net double")
    sent = spark.createDataFrame([], "symbol string, direction string, score double, sent_ms long")
    c = spark.createDataFrame([(1, "s", "LONG", 1.0)], "id int, symbol string, direction string, score double")
    blocked = lambda most, limit: ledgers.safety(c, ledger, sent, now, False, most, limit, 0, 0.0).first().blocked
    assert blocked(2, 0.0) is None and blocked(1, 0.0) == "max_open" and blocked(2, 5.0) == "daily_loss" and blocked(2, 5.1) is None
    quiet = ledgers.safety(c, ledger.where("status is not null"), sent, now, False, 1, 0.0, 0, 0.0).first().blocked
    assert quiet is None  # a settled alert is not open


def test_equal_rows_are_merged_and_counted(spark):
    """Rows that come many times are one with a count, in fits and daily refits alike, and give what all rows one by one give."""
    r = np.random.default_rng(11)
    x = r.integers(0, 4, (3000, 2)).astype(float)
    y = (r.random(3000) < 1 / (1 + np.exp(1.5 - x[:, 0] + 0.5 * x[:, 1]))).astype(int)
    rows = spark.createDataFrame([(i % 2, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))], "k int, a double, b double, y int")
    for f in fits.logistic_fits(rows, ("k",), ("a", "b"), "y", 1.0).collect():
        own = np.arange(3000) % 2 == f.k
        assert f.n == own.sum() and np.allclose([f.intercept, *f.weights], newton(x[own], y[own], 1.0), atol=1e-6)
    n = r.integers(0, 5, (6, 3)).astype(float)
    h = np.floor(n * 0.4)
    d = r.random((6, 2))
    mean, spread, beta = r.random((3, 2)), r.random((3, 2)) + 0.5, r.random((3, 3))
    for k, made in enumerate(fits._grid(d, n, h, mean, spread, beta)):
        z = np.clip((d - mean[k]) / spread[k], -8, 8)
        assert np.allclose(made, fits._parts(z, n[:, k], h[:, k], np.tile(beta[k], (6, 1))).sum(axis=0))


def test_the_capacity_fold_skips_only_rows_that_find_no_place(spark):
    """Dense rows, few places: the same trades as a loop over every row, with places free at or after their end, whole and in chunks."""
    r = random.Random(5)
    rows = [(i, r.choice("abcdef"), t := r.randrange(0, 40) * 3_600_000, t + r.randrange(0, 30) * 3_600_000) for i in range(900)]
    df = spark.createDataFrame([("p", *row) for row in rows], "p string, id long, symbol string, t long, until long")
    for closed in (False, True):
        open_, want = {}, []
        for i, s, t, u in sorted(rows, key=lambda x: (x[2], x[0])):
            open_ = {k: v for k, v in open_.items() if v > t or closed and v == t}
            if s not in open_ and len(open_) < 3:
                open_[s] = u
                want.append(i)
        for bound in (20_000, 50):
            got = folds.capacity(df, ("p",), "id", "t", "until", [F.col("t"), F.col("id")], 3, closed, bound=bound)
            assert sorted(g.id for g in got.collect()) == sorted(want)
