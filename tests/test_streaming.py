"""Streams against their batch forms."""

from pyspark.sql import functions as F

from candela.plans import catalog
from candela.sources import bars as src
from candela.streaming import state as st
from candela.streaming.candles import HOUR, advance

SF = "/root/testdata/sf0.01"


def test_regime_is_earned_kept_and_lost():
    state, seen = (None, "UNKNOWN", 0), []
    for t, raw in [(0, "BULL"), (1, "BULL"), (2, "BULL"), (3, "OFF"), (4, "BULL"), (5, "OFF"), (6, "OFF"), (6, "OFF"), (9, "BULL")]:
        state, regime = advance(state, t, raw, step=1)
        seen.append(regime)
    assert seen == ["UNKNOWN", "UNKNOWN", "BULL", "BULL", "BULL", "BULL", "OFF", "OFF", "UNKNOWN"]
    assert advance(state, 8, "BULL", step=1) == (state, "UNKNOWN")  # late bars never rewind


def test_streamed_regime_follows_the_fold(spark):
    want = []
    rows = src.bars_1h(spark, SF).select("symbol", "open_time_ms", "volume").orderBy("symbol", "open_time_ms").collect()
    state, symbol = None, None
    for r in rows:
        if r.symbol != symbol:
            state, symbol = (None, "UNKNOWN", 0), r.symbol
        raw = "BULL" if r.volume >= 2 else "OFF"
        state, regime = advance(state, r.open_time_ms, raw, HOUR)
        want.append((r.symbol, r.open_time_ms, raw, regime))
    got = sorted(tuple(r) for r in catalog.QUERIES["streamed_regime"](spark, SF).collect())
    assert got == want and {"BULL", "OFF", "UNKNOWN"} <= {w[3] for w in want}


DAY = 86_400_000


def test_settled_setups_leave_no_state(spark, tmp_path):
    """A setup touched, one touched twice, one never, one still waiting: only the waiting one is held at the end."""
    rows = [(1, 0, "open", 5), (1, 3, "touch", 0), (2, 0, "open", 5), (2, 2, "touch", 0), (2, 4, "touch", 0), (3, 1, "open", 6), (4, 38, "open", 43), (9, 40, "open", 41)]
    e = spark.createDataFrame([(i, (t + 1) * DAY, k, (d + 1) * DAY) for i, t, k, d in rows], "id long, t long, kind string, due long").withColumn("at", F.timestamp_millis("t"))
    out = tmp_path.as_uri()
    parts = [e.where(F.col("t") < 30 * DAY), e.where(F.col("t") >= 30 * DAY)]
    got = st.run_parts(spark, parts, lambda r: st.lifecycles(r, 10 * DAY), "lives", out)
    assert sorted(map(tuple, got.collect())) == [(1, "SETTLED", 4 * DAY), (2, "SETTLED", 3 * DAY), (3, "DATA_MISSING", 7 * DAY)]
    assert sorted(r.key.id for r in st.state_rows(spark, out).collect()) == [4, 9]


def test_setups_share_groups(spark, tmp_path, monkeypatch):
    """Thousands of setups cost a few groups and states, and each still has its own deadline; every tenth is never touched."""
    monkeypatch.setattr(st, "BUCKETS", 8)
    ids = spark.range(4000).withColumn("t", F.lit(DAY) + F.col("id") % 50 * DAY)
    kinds = [(F.lit("open"), F.col("t"), F.col("t") + DAY, F.lit(True)), (F.lit("touch"), F.col("t") + DAY // 2, F.lit(0).cast("long"), F.col("id") % 10 != 0)]
    e = None
    for kind, t, due, some in kinds:
        rows = ids.where(some).select("id", t.alias("t"), kind.alias("kind"), due.alias("due")).withColumn("at", F.timestamp_millis("t"))
        e = rows if e is None else e.unionByName(rows)
    out = tmp_path.as_uri()
    got = st.run_parts(spark, [e.where(F.col("t") < 20 * DAY), e.where(F.col("t") >= 20 * DAY)], lambda r: st.lifecycles(r, 5 * DAY), "many", out)
    last = 50 * DAY + DAY // 2
    start = lambda i: DAY + i % 50 * DAY
    want = [(i, "SETTLED", start(i) + DAY // 2) if i % 10 else (i, "DATA_MISSING", start(i) + DAY) for i in range(4000) if i % 10 or start(i) + 6 * DAY < last]
    assert sorted(map(tuple, got.collect())) == want
    raw = spark.read.format("statestore").option("stateVarName", st.VALUE).load(f"{out}/progress")
    assert raw.select("key").distinct().count() <= 8
    assert sorted(r.key.id for r in st.state_rows(spark, out).collect()) == [i for i in range(4000) if start(i) + 6 * DAY >= last]


def test_a_deadline_at_the_watermark_is_not_lost(spark, tmp_path, monkeypatch):
    """A setup whose time ends exactly at a watermark is reported when event time has passed it, whatever its group did before."""
    monkeypatch.setattr(st, "BUCKETS", 1)
    rows = [(1, 0, 1), (2, 0, 5), (3, 15, 16), (4, 40, 41)]
    e = spark.createDataFrame([(i, (t + 1) * DAY, "open", (d + 1) * DAY) for i, t, d in rows], "id long, t long, kind string, due long").withColumn("at", F.timestamp_millis("t"))
    parts = [e.where("id < 3"), e.where("id = 3"), e.where("id = 4")]
    got = st.run_parts(spark, parts, lambda r: st.lifecycles(r, 10 * DAY), "exact", tmp_path.as_uri())
    assert sorted(r.id for r in got.collect()) == [1, 2, 3]  # 2 ends with the day on which 3 opens


def test_deliveries_are_forgotten_after_their_cooldown(spark, tmp_path):
    rows = [("a", 0, 1, 1.0), ("a", 2, 2, 1.5), ("a", 3, 3, 2.5), ("b", 1, 4, 1.0), ("b", 20, 5, 0.1), ("b", 20, 5, 0.1), ("c", 30, 6, 1.0), ("c", 31, 7, 1.0)]
    s = spark.createDataFrame([(k, (t + 1) * DAY, i, x) for k, t, i, x in rows], "key string, t long, id long, score double").withColumn("at", F.timestamp_millis("t"))
    out = tmp_path.as_uri()
    got = st.run_parts(spark, [s.where(F.col("t") < 10 * DAY), s.where(F.col("t").between(10 * DAY, 26 * DAY)), s.where(F.col("t") > 26 * DAY)], lambda r: st.deliveries(r, 5 * DAY, 1.0), "sent", out)
    want = {1: "SENT", 2: "COOLDOWN", 3: "SENT", 4: "SENT", 5: "SENT", 6: "SENT", 7: "COOLDOWN"}
    assert {r.id: r.action for r in got.collect()} == want
    assert [r.key.key for r in st.state_rows(spark, out).collect()] == ["c"]
    assert {r.id: r.action for r in st.deliveries(s, 5 * DAY, 1.0).collect()} == want  # the batch form


def test_regime_machine_by_cases():
    """Earned in three, kept in the band, left in two that fail alike, at once when it breaks, lost over gaps and without health."""
    step = st.regime_step(1)
    strong, band, weak, worse, broken = (0.9, 0.7, 0.8, True), (0.5, 0.52, 0.8, True), (0.6, 0.4, 0.8, True), (0.5, 0.4, 0.8, True), (0.5, 0.3, 0.8, True)
    def run(*bars):
        state, seen = None, []
        for t, raw, bar, healthy in bars:
            state, out = step(state, (t, raw, *bar, healthy))
            seen.append(out[2])
        return seen
    earned = [(t, "BULL", strong, True) for t in range(3)]
    assert run(*earned) == ["TRANSITION", "TRANSITION", "BULL"]
    assert run(*earned, (3, "OFF", band, True), (4, "OFF", weak, True), (5, "OFF", worse, True))[3:] == ["BULL", "BULL", "OFF"]
    assert run(*earned, (3, "OFF", weak, True), (4, "BULL", strong, True), (5, "OFF", weak, True))[3:] == ["BULL"] * 3
    assert run(*earned, (3, "OFF", broken, True))[3:] == ["OFF"]
    assert run(*earned, (5, "BULL", strong, True), (6, "BULL", strong, True), (7, "BULL", strong, True))[3:] == ["UNKNOWN", "UNKNOWN", "BULL"]
    assert run(*earned, (3, "BULL", strong, False), (4, "BULL", strong, True))[3:] == ["UNKNOWN", "UNKNOWN"]
    assert run(*earned, (2, "OFF", broken, True), (1, "BULL", strong, True), (3, "BULL", strong, True))[3:] == ["BULL", "UNKNOWN", "BULL"]
    assert set(st.regime_moves()) == {(b, name) for b in (True, False) for name, *_ in st.regime_classes(0.6)}
