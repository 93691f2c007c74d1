"""Outcomes on entry grids by loops, trade reports and the live frame in slices."""

import random

import pytest
from pyspark.sql import functions as F

from candela.operators import market as mk
from candela.operators import outcomes as oc
from candela.operators import summaries as sm
from candela.sources import bars as src

STEP, NOW, HOLD = 60, 60 * 150 + 7, 20


def plain_entry(record, candles, grid, level):
    """(mature, complete, entry, hit, first, net) by one walk over the candles."""
    _, _, at, stop, cost = record
    start = (at // grid + 1) * grid
    end = start + HOLD * STEP
    times = range(start, min(end, NOW // STEP * STEP), STEP)
    mature = end <= NOW
    if not len(times) or any(t not in candles for t in times):
        return mature, False, None, None, None, None
    entry, hit, stopped = candles[times[0]][0], None, None
    for k, t in enumerate(times):
        _, high, low, close = candles[t]
        if hit is None and (high / entry - 1) * 100 >= level - 1e-9:
            hit = k
        if stopped is None and (1 - low / entry) * 100 >= stop - 1e-9:
            stopped = k
    met = True if hit is not None else False if mature else None
    if hit is not None and hit == stopped:
        return mature, True, entry, met, None, None
    if hit is not None and (stopped is None or hit < stopped):
        return mature, True, entry, met, True, level * 100 - cost
    if stopped is not None:
        return mature, True, entry, met, False, -stop * 100 - cost
    return (mature, True, entry, met, False, (close / entry - 1) * 10_000 - cost) if mature else (mature, True, entry, met, None, None)


def test_grid_entries_by_loops(spark):
    r = random.Random(5)
    price, series = {"a": 100.0, "b": 50.0}, {"a": {}, "b": {}}
    for t in range(0, NOW, STEP):
        for s in price:
            if t in (2400, 7200) and s == "b":
                continue  # gaps
            o = price[s]
            c = o * (1 + r.gauss(0, 0.008))
            series[s][t] = (o, max(o, c) * (1 + r.random() * 0.006), min(o, c) * (1 - r.random() * 0.006), c)
            price[s] = c
    rows = [(s, t, *map(float, x), t + STEP - 1) for s, own in series.items() for t, x in own.items()]
    rows.append(("b", 2400, 1.0, 1.0, 1.0, 1.0, 2400 + 5))  # ends too soon: counts as missing
    bars = spark.createDataFrame(rows, "symbol string, open_time_ms long, open double, high double, low double, close double, close_time_ms long")
    records = [(f"{i}", r.choice("ab"), r.randrange(0, NOW + 400), r.choice([0.5, 1.0, 2.5]), 12.0) for i in range(250)] + [("none", "z", 30, 1.0, 12.0)]
    docs = spark.createDataFrame(records, "id string, symbol string, recorded_ms long, stop_pct double, cost_bps double")
    got = {(x.id, x.grid_ms, x.level): x for x in oc.grid_entries(docs, bars, NOW, STEP, (60, 300), HOLD, (1, 2)).collect()}
    assert len(got) == len(records) * 4
    kinds = set()
    for rec in records:
        for grid in (60, 300):
            for level in (1.0, 2.0):
                x = got[rec[0], grid, level]
                want = plain_entry(rec, series.get(rec[1], {}), grid, level)
                assert (x.mature, x.complete, x.entry_price, x.hit, x.first_before_stop) == want[:5], (rec, grid, level)
                assert x.net_bps == (None if want[5] is None else pytest.approx(want[5]))
                kinds.add(want[:2] + want[3:5])
    assert len(kinds) >= 8  # mature and open, complete and not, won, lost, undecided, both in one candle
    assert oc.grid_entries(docs.limit(0), bars, NOW, STEP, (60,), HOLD).collect() == []


def test_live_frame_is_that_of_whole_series(spark):
    bars = src.calm(src.bars_1d(spark, "/root/testdata/sf0.001"))
    limits = {"z1": 1.0, "z2": 0.5, "shock": 1.0}
    whole = mk.live_marks(mk.indicators(bars), **limits)
    cols = ["symbol", "open_time_ms", "ema576", "rsi", "vz", "taker12", "f_F1", "f_B2", "f_B4", "rn"]
    shown = lambda d: sorted(map(str, d.select(*[F.round(c, 7).alias(c) if c in ("ema576", "rsi", "vz", "taker12") else c for c in cols]).collect()))
    assert shown(mk.live_frame(bars, size=600, **limits)) == shown(whole)
    gate = F.col("open_time_ms") % 2 == 0
    one = mk.live_families(whole, gate, 2, **limits)
    two = mk.live_rules(mk.indicators(bars), gate, **limits).unionByName(mk.relative_entries(mk.indicators(bars), gate, 2))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_trade_report(spark):
    day = 86_400_000
    rows = [("a", i * day, "STOP" if i % 3 else "TARGET", float(10 if i % 3 == 0 else -4)) for i in range(9)] + [("a", 99 * day, "DATA_MISSING", None), ("b", 0, "STOP", -1.0), ("c", 0, "DATA_MISSING", None), ("b", day, None, 2.0)]
    got = {r.symbol: r for r in sm.trade_report(spark.createDataFrame(rows, "symbol string, event_ms long, reason string, net_bps double")).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].reasons == {"STOP": 6, "TARGET": 3, "DATA_MISSING": 1} and got["a"].trades == 9 and got["a"].low <= got["a"].mean_net <= got["a"].high
    assert got["b"].reasons == {"STOP": 1} and got["b"].low is None and got["b"].trades == 2
