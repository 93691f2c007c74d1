"""Operators without SQL, and those that raise, against plain code."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.operators import desk, models, outcomes, summaries, sweeps
from candela.plans import catalog
from candela.sources import bars as src
from candela.streaming import state

SF = "/root/testdata/sf0.001"


def newton(x, y, l2, penalised):
    """Minimum of the summed log loss plus l2/2 of the squared penalised weights, by Newton's method."""
    d = np.column_stack([np.ones(len(y)), x])
    b, p = np.zeros(d.shape[1]), np.diag([0.0, *([l2] * penalised)])
    for _ in range(100):
        q = 1 / (1 + np.exp(-d @ b))
        step = np.linalg.solve(d.T @ (d * (q * (1 - q))[:, None]) + p, d.T @ (q - y) + p @ b)
        b -= step
        if np.abs(step).max() < 1e-10:
            break
    return b


def test_logistic_and_platt_follow_newton(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 3))
    y = (x @ [0.8, -0.5, 0.1] + r.normal(size=400) > 0.3).astype(float)
    d = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "a double, b double, c double, y int")
    for l2 in (1.0, 10.0):
        intercept, weights = models.fit_logistic(d, ("a", "b", "c"), "y", l2)
        assert np.allclose([intercept, *weights], newton(x, y, l2, 3), atol=1e-5)
    z = d.withColumn("logit", models.linear(("a", "b", "c"), intercept, weights))
    slope, base = models.fit_platt(z, "logit", "y")
    want = newton((x @ weights + intercept)[:, None], y, 0.01, 1)
    assert np.allclose([base, slope], want, atol=1e-5)
    flipped = models.fit_platt(z.withColumn("y", 1 - F.col("y")), "logit", "y")  # a negative slope is refused
    assert flipped[0] == 0 and flipped[1] == pytest.approx(math.log((1 - y.mean()) / y.mean()))
    assert models.fit_platt(z.withColumn("y", F.lit(1)), "logit", "y")[0] == 0
    assert models.bonferroni_z(1) == pytest.approx(1.959964, abs=1e-6) and models.bonferroni_z(6) == pytest.approx(2.638257, abs=1e-6)


def test_fitted_scores_are_probabilities(spark):
    rows = catalog.QUERIES["logistic_scores"](spark, SF).collect()
    assert len(rows) > 500 and all(0 < r.probability < 1 for r in rows) and {r.role for r in rows} == {"train", "embargo", "calibration"}


def test_capacity_and_overlap_by_loops(spark):
    rows = [(s, t, h, 1.0) for s, t, h in [("a", 0, 3), ("b", 0, 2), ("c", 1, 1), ("a", 2, 1), ("b", 2, 5), ("c", 3, 2), ("a", 3, 1), ("d", 9, 1)]]
    d = spark.createDataFrame(rows, "symbol string, event_ms long, held long, net_bps double")
    open_until, want = {}, []
    for s, t, h, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        open_until = {k: v for k, v in open_until.items() if v > t}
        if s not in open_until and len(open_until) < 2:
            open_until[s] = t + h
            want.append((s, t))
    assert sorted((r.symbol, r.event_ms) for r in summaries.capacity_limited(d, 1, 2).collect()) == sorted(want)
    free, alone = {}, []
    for s, t, h, _ in sorted(rows, key=lambda r: r[1]):
        if t >= free.get(s, -1):
            free[s] = t + h
            alone.append((s, t))
    assert sorted((r.symbol, r.event_ms) for r in summaries.non_overlapping(d, 1).collect()) == sorted(alone)


def test_daily_cap_by_loops(spark):
    from candela.sources.ledger import signals

    day = 86_400_000
    rows = [(r.family, r.id, r.symbol, r.bar_ms, r.score) for r in signals(spark, SF).collect()]
    free, taken, want = {}, {}, []
    for arm, i, s, t, score in sorted(rows, key=lambda r: (r[3], -r[4], r[2], r[1])):
        if t >= free.get((arm, s), t) and taken.get((arm, t // day), 0) < 2:
            free[arm, s] = t + 2 * day
            taken[arm, t // day] = taken.get((arm, t // day), 0) + 1
            want.append((arm, i))
    assert sorted(tuple(r) for r in catalog.QUERIES["daily_capped_signals"](spark, SF).collect()) == sorted(want) and len(want) < len(rows)


def test_sweep_pattern(spark):
    none = (None, None, None)
    base = [(0, 11, 9, 10, 9, 11, 10.2), (1, 10.5, 9.5, 10, *none), (2, 12, 8, 10, *none)]  # both ends: neither
    down = [(3, 10, 8.5, 8.8, *none), (4, 9.5, 8.2, 9.2, *none), (5, 10.5, 9.1, 10.1, *none), (6, 10.8, 9.9, 10.4, *none)]
    assert sweeps.follow([*base, *down]) == (None, [(6, "LONG", 10.2, 8.2, 3)])
    up = [(3, 11.5, 10, 10.8, *none), (4, 10.9, 9.8, 10.1, *none)]
    assert sweeps.follow([*base, *up]) == (None, [(4, "SHORT", 10.2, 11.5, 3)])
    late = [(3, 10, 8.5, 9.5, *none), *((t, 10, 9.2, 9.6, *none) for t in range(4, 17)), (17, 11, 9, 10.9, *none)]
    assert sweeps.follow([*base, *late]) == (None, [])
    r = np.random.default_rng(2)
    rows = []
    for t in range(300):
        o, c, v = r.normal(100, 0.4), r.normal(100, 0.4), float(r.integers(1, 50))
        rows.append(("a", t, float(o), float(max(o, c) + abs(r.normal(0, 0.3))), float(min(o, c) - abs(r.normal(0, 0.3))), float(c), v))
    b = spark.createDataFrame(rows, "symbol string, open_time_ms long, open double, high double, low double, close double, volume double")
    got = sweeps.ranges_with_poc(b, 20, 30, 3.0).collect()
    assert len(got) > 20
    for x in got[:40]:
        best = None
        for n in range(20, 31):
            part = rows[x.open_time_ms - n + 1 : x.open_time_ms + 1]
            if len(part) == n and (min(p[4] for p in part), max(p[3] for p in part)) == (x.range_low, x.range_high):
                w = (x.range_high - x.range_low) / 40
                v = [sum(p[6] * max(0.0, min(p[3], x.range_low + i * w + w) - max(p[4], x.range_low + i * w)) / (p[3] - p[4]) for p in part) for i in range(40)]
                best = x.range_low + (v.index(max(v)) + 0.5) * w
                break
        assert best == pytest.approx(x.poc)
    assert sweeps.sweep_signals(b, least=20, most=30, k=3.0).columns[:3] == ["symbol", "open_time_ms", "side"]


def test_gap_check_raises(spark):
    b = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3)], "symbol string, open_time_ms long")
    assert desk.gap_free(b.where("open_time_ms < 3"), 1).count() == 2
    with pytest.raises(Exception, match="gap in a"):
        desk.gap_free(b, 1).collect()


def test_regime_machine_cases():
    step = state.regime_step(1)

    def run(rows):
        s, out = None, []
        for r in rows:
            s, made = step(s, r)
            out.append(made[2])
        return out

    strong, weak, severe = ("BULL", 0.9, 0.7, 1.0, True, True), ("OFF", 0.3, 0.45, 0.5, False, True), ("OFF", 0.2, 0.2, 0.25, False, True)
    hold = ("TRANSITION", 0.6, 0.52, 0.75, True, True)
    assert run([(t, *strong) for t in (1, 2, 3, 4)]) == ["TRANSITION", "TRANSITION", "BULL", "BULL"]
    assert run([*((t, *strong) for t in (1, 2, 3)), (4, *hold), (5, *weak), (6, *strong), (7, *weak), (8, *weak)])[3:] == ["BULL", "BULL", "BULL", "BULL", "OFF"]
    assert run([*((t, *strong) for t in (1, 2, 3)), (4, *severe)])[-1] == "OFF"
    assert run([*((t, *strong) for t in (1, 2, 3)), (5, *strong), (6, *strong), (7, *strong)])[3:] == ["UNKNOWN", "UNKNOWN", "BULL"]
    assert run([*((t, *strong) for t in (1, 2, 3)), (3, *weak), (2, *strong), (4, *strong[:5], False), (5, *strong)])[3:] == ["BULL", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_candle_ties_do_not_depend_on_order(spark):
    rows = [("a", 1, 2.0), ("a", 1, 3.0), ("a", 2, 5.0)]
    d = lambda r: spark.createDataFrame(r, "symbol string, open_time_ms long, close double").repartition(3)
    assert {tuple(x) for x in src.keep_last(d(rows), d(rows[:2])).collect()} == {tuple(x) for x in src.keep_last(d(rows[::-1]), d(rows[1::-1])).collect()}


def test_paths_keep_gaps(spark):
    b = spark.createDataFrame([("a", t, 1.0, 2.0, 0.5, 1.5) for t in (0, 1, 3, 4)], "symbol string, open_time_ms long, open double, high double, low double, close double")
    e = b.where("open_time_ms = 0").selectExpr("symbol", "open_time_ms event_ms").union(spark.createDataFrame([("b", 0)], "symbol string, event_ms long"))
    got = {r.symbol: [x.k for x in r.path] for r in outcomes.with_path(e, b, 1, 3, bucket=2).collect()}
    assert got == {"a": [1, 3], "b": []}
