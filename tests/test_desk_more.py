"""Slices, scenarios, coverage, manifests, sinks, alerts and rankers on small cases and against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from candela.functions.scalars import frame, series
from candela.functions.slices import in_slices, numbered
from candela.operators import desk, fits, ledgers, models, studies
from candela.sources import files

from test_fits import newton

DAY = 86_400_000


@pytest.mark.parametrize("size, before, after", [(7, 6, 3), (1, 6, 3), (1000, 6, 3), (5, 20, 20)])
def test_slices_give_what_whole_series_give(spark, size, before, after):
    """Series of 1, 3 and 200 rows, with gaps; slices shorter than their halo; rows that the function leaves out or makes two of."""
    r = random.Random(3)
    rows = [(s, t * DAY // 3, r.random()) for s, n in (("a", 200), ("b", 3), ("c|d", 1)) for t in sorted(r.sample(range(4 * n), n))]
    b = spark.createDataFrame(rows, "symbol string, open_time_ms long, x double").repartition(4)

    def f(d):
        w = series()
        d = d.withColumns({"top": F.max("x").over(frame(w, 6, -1)), "n": F.count("x").over(frame(w, 6, -1)), "old": F.lag("x", 6).over(w), "next": F.min("x").over(w.rowsBetween(1, 3))})
        return d.where("x > 0.1").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).select("symbol", "open_time_ms", "top", "n", "old", "next", "copy")

    assert sorted(map(tuple, in_slices(b, f, before, after, size).collect()), key=str) == sorted(map(tuple, f(b).collect()), key=str)
    assert in_slices(b.where("false"), f, before, after, size).count() == 0
    want = b.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("open_time_ms")) - 1)
    assert sorted(map(tuple, numbered(b, "n").collect())) == sorted(map(tuple, want.collect()))


def test_scenarios_fall_back(spark):
    rows = [(p, v, float(p * 10 + v + k), k % 2 == 0, k % 3 == 0) for p, v, n in ((0, 0, 30), (0, 1, 3), (1, 0, 4)) for k in range(n)] + [(2, 2, None, True, True)]
    d = spark.createDataFrame(rows, "pp int, vv int, x double, u boolean, d boolean")
    cells = studies.scenario_cells(d, F.col("pp"), F.col("vv"), "x", F.col("u"), F.col("d"))
    items = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 1, 0), (4, 9, 9), (4, 9, 9)], "i int, a int, b int")
    got = sorted(tuple(r[c] for c in ("i", "level", "n")) for r in studies.scenario_lookup(items, cells, F.col("a"), F.col("b"), 10).collect())
    assert got == [(1, 0, 30), (2, 1, 33), (3, 2, 37), (4, 2, 37), (4, 2, 37)]
    whole = cells.where("level = 2").first()
    assert whole.n == 37 and whole.touch_up == pytest.approx(np.mean([r[3] for r in rows[:-1]])) and whole.touch_neither == pytest.approx(np.mean([not r[3] and not r[4] for r in rows[:-1]]))


def test_coverage_counts_gaps_and_stamps_beside_the_grid(spark):
    oi = spark.createDataFrame([("s", t, v) for t, v in [(0, 1.0), (10, 1.0), (20, 1.0), (25, 1.0), (30, 0.0), (50, 1.0), (60, 1.0), (70, float("inf")), (80, None)]] + [("none", 5, 1.0)], "series string, t long, v double")
    candles = spark.createDataFrame([(s, t) for s in ("s", "none") for t in range(0, 120, 10)], "series string, close_ms long")
    got = {(r.series, r.lag): r for r in desk.oi_coverage(oi, candles, 10, (1, 2), points=3).collect()}
    one = got["s", 1]
    assert (one.rows, one.off_grid, one.grid_rows, one.gaps, one.largest_ms, one.invalid) == (9, 1, 8, 1, 20, 3)
    assert (one.eligible, one.complete, one.missing, one.days) == (7, 1, 6, 1)  # closes 30 to 90; only the window 0, 10, 20 is whole
    assert (got["s", 2].eligible, got["s", 2].complete) == (7, 1) and ("none", 1) not in got


def test_ladder_of_nulls_and_other_sides(spark):
    name = desk.register_levels(spark)
    d = spark.createDataFrame([(1, 100.0, "LONG"), (2, 100.0, "SHORT"), (3, None, "LONG"), (4, 1.0, "x"), (5, 1.0, None)], "id int, price double, side string")
    got = spark.sql(f"SELECT id, level, target FROM {{d}}, LATERAL {name}(price, side)", d=d).collect()
    assert sorted((r.id, round(r.target, 9)) for r in got) == [(1, 102.0), (1, 103.0), (1, 105.0), (2, 95.0), (2, 97.0), (2, 98.0)]


def test_manifest_of_odd_files(spark, tmp_path):
    import hashlib

    text = {"symbol=A/x.csv": "open_time_ms,n\n0,1\n1,1\n3,1\n4,1\n5,1\n", "symbol=A/y.csv": "open_time_ms,n\n0,1\n1,1\n2,1\n", "symbol=B/z.csv": "open_time_ms,n\n0,1\n0,1\n1,1\n", "symbol=C/w.csv": "open_time_ms,n\nbad,1\n"}
    for name, content in text.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    got = {r.file.split("/")[-1]: r for r in files.file_manifest(spark, tmp_path.as_uri(), 1, "open_time_ms long, n long").collect()}
    assert {k: (r.status, r.segments, r.longest, r.invalid) for k, r in got.items()} == {"x.csv": ("SELECTED", 2, 3, 0), "y.csv": ("AVAILABLE", 1, 3, 0), "z.csv": ("SKIP_DUPLICATE", 1, 2, 0), "w.csv": ("SKIP_NO_VALID_BARS", 0, 0, 1)}
    assert all(got[k.split("/")[-1]].sha256 == hashlib.sha256(v.encode()).hexdigest() and got[k.split("/")[-1]].bytes == len(v) for k, v in text.items())


def test_sinks_take_their_place(spark, tmp_path):
    path = (tmp_path / "t").as_uri()
    spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double").write.parquet(path)
    assert files.append_keep_last(spark, path, spark.createDataFrame([(2, 5.0), (3, 3.0)], "k int, v double"), ("k",), "v") == 1
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 1.0), (2, 5.0), (3, 3.0)]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    bar = lambda s, t: (s, t * DAY, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1, 1.0, t * DAY + DAY - 1)
    kind = f"symbol string, {files.CANDLE}"
    sink = (tmp_path / "c").as_uri()
    spark.createDataFrame([bar("gone", 1), bar("kept", 90)], kind).write.partitionBy("symbol").parquet(sink)
    files.retain(spark, sink, spark.createDataFrame([bar("kept", 91)], kind), DAY, 100 * DAY, 30)
    assert {p.name for p in (tmp_path / "c").iterdir() if p.is_dir()} == {"symbol=kept"} and spark.read.parquet(sink).count() == 2


def test_universe_with_and_without_a_cap(spark):
    c = spark.createDataFrame([(s, -age * DAY) for s, age in [("a", 400), ("b", 20), ("c", 30), ("d", 500), ("e", 5), ("f", 600), ("g", 700), ("h", 800)]], "symbol string, onboard_ms long")
    s = spark.createDataFrame([("a", 50.0, 1.0, 1.0), ("b", 10.0, 1.0, 1.0), ("c", 90.0, -3.0, 0.0), ("d", 70.0, 1.0, 1.0), ("e", 99.0, 1.0, 1.0), ("f", 60.0, 9.0, 1.0), ("g", 80.0, 1.0, -1.0), ("h", None, 1.0, 1.0)], "symbol string, quote_volume double, funding_bps double, spread_bps double")
    of = lambda cap: [r.symbol for r in ledgers.universe(c, s, 0, 10.0, 5.0, 2.0, cap).orderBy("place").collect()]
    assert of(0) == ["c", "d", "a", "b"] and of(4) == ["b", "c", "d", "a"] and of(3) == ["c", "d", "a"]


def test_owner_alerts_by_conditions(spark):
    t0, q = 100 * DAY, 900_000
    rec = [("ok", "A", "LB1", "CONFIRMED", 2.0, -60_000, -60_000), ("later", "A", "LB1", "CONFIRMED", 9.0, -30_000, -60_000), ("sent", "B", "LP1", "CONFIRMED", 2.0, -1, -1), ("told", "C", "LB1", "CONFIRMED", 2.0, -1, -1),
           ("stale", "D", "LB1", "CONFIRMED", 2.0, -q - 1, -1), ("old", "E", "LB1", "CONFIRMED", 2.0, -1, -q - 1), ("watch", "F", "LB1", "WATCH", 2.0, -1, -1), ("other", "G", "LA1", "CONFIRMED", 2.0, -1, -1), ("low", "H", "LB1", "CONFIRMED", 0.5, -1, -1), ("edge", "I", "LP1", "CONFIRMED", 1.0, -q, -q)]
    r = spark.createDataFrame([(i, s, st, sg, x, t0 + a, t0 + b) for i, s, st, sg, x, a, b in rec], "id string, symbol string, strategy string, stage string, score double, recorded_ms long, source_ms long")
    got = spark.createDataFrame([("sent", "B", t0 - 1), ("before", "C", t0 - DAY + 1), ("long ago", "A", t0 - DAY)], "id string, symbol string, delivered_ms long")
    runs = lambda **k: spark.createDataFrame([({"now_ms": t0, "started_ms": 0, "scanned_ms": t0, "regime": "BULL_CONFIRMED", "healthy": True} | k)], "now_ms long, started_ms long, scanned_ms long, regime string, healthy boolean")
    ids = lambda **k: sorted(x.id for x in ledgers.owner_alerts(r, got, runs(**k), 1.0).collect())
    assert ids() == ["edge", "ok"]
    assert ids(regime="OFF") == ids(healthy=False) == ids(scanned_ms=t0 - 3_600_000) == ids(started_ms=t0) == []
    assert ids(started_ms=t0 - 60_000) == ["ok"]


@pytest.mark.parametrize("bound", [1, 10_000])
def test_records_on_dense_scans(spark, bound):
    r = random.Random(6)
    rows = [("p", i, t * 3_600_000, f"s{r.randrange(12)}", r.choice("xy"), r.random() < 0.5, r.random()) for i, t in enumerate(t for t in range(300) for _ in range(r.randrange(1, 5)))]
    d = spark.createDataFrame(rows, "profile string, id long, t long, symbol string, strategy string, confirmed boolean, score double").repartition(3)
    got = sorted(x.id for x in ledgers.long_records(d, DAY, 2 * DAY, 2, 6, bound).collect())
    last, ends, want = {}, [], []
    for t in sorted({v[2] for v in rows}):
        for _, i, _, s, st, c, x in sorted((v for v in rows if v[2] == t), key=lambda v: (not v[5], -v[6]))[:2]:
            ends = [e for e in ends if e > t]
            if len(ends) < 6 and t - last.get((s, st), -DAY) >= DAY:
                last[s, st] = t
                ends.append(t + 2 * DAY)
                want.append(i)
    assert got == sorted(want) and 10 < len(want) < len(rows)


def test_pivot_windows(spark):
    rows = [(1, "S", "R", "LONG", ["B", "A", "A"], True, 10 * DAY, 2, "TARGET", True), (1, "S", "R", "LONG", ["A", "B"], True, 10 * DAY, 3, "DATA_MISSING", True), (2, "S", "R", "LONG", ["A", "B"], None, 20 * DAY, 2, None, None), (3, None, None, None, [], False, 20 * DAY, 2, "STOP", False), (4, "S", "R", "LONG", ["A"], True, 20 * DAY, 7, "TARGET", True)]
    d = spark.createDataFrame(rows, "id int, strategy string, regime string, direction string, families array<string>, notified boolean, source_ms long, level int, status string, success boolean")
    got = {r.setup: r for r in ledgers.target_pivot(d, 20 * DAY).collect()}
    a = got["LONG A+B"]
    assert (a.hits_2, a.pending_2, a.missing_3, a.hits_3, a.rate_2, a.rate_3, a.signals) == (1, 1, 1, 0, 1.0, None, 2) and a.low_3 is None and 0 < a.low_2 < a.high_2 == 1
    assert got["UNKNOWN UNKNOWN"].misses_2 == 1 and len(got) == 2
    size = lambda **k: sorted((r.setup, r.signals) for r in ledgers.target_pivot(d, 20 * DAY, **k).collect())
    assert size(audience="notified") == [("LONG A+B", 1)] and size(audience="other") == [("LONG A+B", 1), ("UNKNOWN UNKNOWN", 1)]
    assert size(days=5) == [("LONG A+B", 1), ("UNKNOWN UNKNOWN", 1)] and size(until="1970-01-12") == [("LONG A+B", 1)] and size(since="1971-01-01") == []


def test_ranker_by_loops(spark):
    r = np.random.default_rng(7)
    rows = []
    for fold in (0, 1):
        for role, n in (("train", 200), ("calibration", 60), ("test", 50)):
            x = r.normal(size=(n, 2)) * [1, 5] + [0, 3]
            y = (r.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
            rows += [(fold, role, len(rows) + k, float(a), None if k % 9 == 0 else float(b), int(t)) for k, ((a, b), t) in enumerate(zip(x, y))]
    got = {g.id: g for g in fits.ranked(spark.createDataFrame(rows, "fold int, role string, id int, a double, b double, y int"), ("fold",), ("a", "b"), "y").collect()}
    assert len(got) == 100
    for fold in (0, 1):
        of = lambda role: [v for v in rows if v[:2] == (fold, role)]
        med = [np.median([v[c] for v in of("train") if v[c] is not None]) for c in (3, 4)]
        x = lambda role: np.array([[med[i] if v[c] is None else v[c] for i, c in enumerate((3, 4))] for v in of(role)])
        m, s = x("train").mean(0), x("train").std(0)
        z = lambda role: np.clip((x(role) - m) / s, -8, 8)
        b = newton(z("train"), np.array([v[5] for v in of("train")], float), 10.0)
        cut = np.quantile(b[0] + z("calibration") @ b[1:], 0.8)
        for v, score in zip(of("test"), b[0] + z("test") @ b[1:]):
            assert got[v[2]].score == pytest.approx(score, abs=1e-6) and got[v[2]].threshold == pytest.approx(cut, abs=1e-6) and got[v[2]].selected == (score >= cut)


def test_bundles_that_cannot_be_used(spark):
    newest = spark.createDataFrame([("a", 1.0, -2.0, 100.0, 50.0), ("b", 1.0, 1.0, 1.0, 1.0), ("c", 1.0, 1.0, 1.0, 1.0), ("d", 1.0, 1.0, 1.0, 1.0)], "symbol string, f double, g double, close double, barrier_bps double")
    one = lambda s, v=1, w=(0.5, 1.0), dev=(1.0, 2.0): (s, v, ["f", "g"], [0.0, 0.0], list(dev), 0.1, list(w), 2.0, 0.3)
    saved = spark.createDataFrame([one("a"), one("b", 2), one("c", w=(float("nan"), 1.0)), one("d", dev=(0.0, 1.0))], "symbol string, version int, features array<string>, means array<double>, deviations array<double>, intercept double, weights array<double>, slope double, offset double")
    (r,) = fits.bundle_scores(newest, saved, ("symbol",), ("f", "g"), 1).collect()
    p = 1 / (1 + np.exp(-(2 * (0.1 + 0.5 - 1.0) + 0.3)))
    assert r.symbol == "a" and r.probability == pytest.approx(p) and r.direction == "DOWN" and r.contributions == "g,f" and r.low_price == pytest.approx(100 * np.exp(-0.005))


def test_lift_of_open_and_settled_rows(spark):
    rows = [(2.0, "LONG", True, 0.8, 0.5, 1, 0), (2.0, "SHORT", True, 0.9, 0.5, 1, 0), (2.0, "SHORT", False, 0.2, 0.5, 0, 1), (2.0, "LONG", True, 0.8, 0.5, None, None)]
    (g,) = models.side_lift(spark.createDataFrame(rows, "level double, side string, selected boolean, p double, base_p double, hit_long int, hit_short int")).collect()
    assert (g.n, g.hits, g.selected, g.selected_hits, g.false_alerts, g.missed, g.recall) == (3, 2, 2, 1, 1, 1, 0.5) and g.always_long == pytest.approx(2 / 3)


def test_pending_folder_of_odd_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.json").write_text('{"id": 1, "x": 2.0}\n\n{"id": 2')
    (tmp_path / "2.json").write_text('{"id": 3, "x": -1.0}\n{"id": 4}\n[1]\n{"x": 1.0}')
    good, bad = files.read_pending(spark, tmp_path.as_uri(), "id long, x double", {"x": F.col("x") > 0})
    assert [tuple(r) for r in good.collect()] == [(1, 2.0)] and sorted((r.file[-6:], r.problem) for r in bad.collect()) == [("1.json", "json"), ("2.json", "json"), ("2.json", "json"), ("2.json", "x"), ("2.json", "x")]


def test_spacing_takes_the_smallest_id_of_one_time(spark):
    rows = spark.createDataFrame([(9, "k", 5, 8), (2, "k", 5, 8), (4, "k", 5, 8), (1, "k", 7, 10), (7, "k", 8, 11), (3, "k", 8, 11)], "id long, key string, t long, until long")
    assert sorted(r.id for r in desk.spaced(rows, "key", "t", "until", "id").collect()) == [2, 3]


def test_touch_lift_gathers_no_level(spark):
    """The base rate's error comes from sums: no window holds a level's rows, and the figures are those of loops."""
    moves = [(float(m), i % 7 / 6) for i, m in enumerate((10, 60, 120, 250, 40, 99, 100, 51))]
    out = models.touch_lift(spark.createDataFrame(moves, "move double, p double"), (50, 100))
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        hits = [int(m >= r.level) for m, _ in moves]
        base = sum(hits) / len(hits)
        assert abs(r.base_brier - sum((base - h) ** 2 for h in hits) / len(hits)) < 1e-12 and r.hits == sum(hits)
