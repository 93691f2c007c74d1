"""Each library query against its SQL, and operators on small candles."""

import duckdb
import pytest
from pyspark.sql import functions as F

from candela.functions.ewm import ewm
from candela.operators import events
from candela.plans import catalog
from candela.sources import bars as src

SF = "/root/testdata/sf0.001"


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events", "orders", "supplier", "nation", "part"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


def test_ewm_follows_the_recursion(spark):
    rows = [("s", i, float((i * 37) % 11) + 1) for i in range(500)]
    y, want = None, []
    for _, _, x in rows:
        y = x if y is None else 0.25 * x + 0.75 * y
        want.append(y)
    got = ewm(spark.createDataFrame(rows, "symbol string, open_time_ms long, x double"), "x", 0.25, "y").orderBy("open_time_ms").collect()
    assert [r.y for r in got] == pytest.approx(want, rel=1e-12)


def candles(spark, rows):
    return spark.createDataFrame([("s", i, *map(float, r)) for i, r in rows], "symbol string, open_time_ms long, open double, high double, low double, close double")


@pytest.mark.parametrize(("path", "reason", "gross"), [
    ([(100, 103, 98, 100)], "STOP", -150),  # both in one candle: the stop comes first
    ([(100, 103, 99, 100)], "TARGET", 200),
    ([(100, 101, 99, 100), (97, 98, 96, 97)], "STOP_GAP", -300),
    ([(100, 101, 99, 100)] * 2 + [(100, 101, 99, 100.5)], "TIME_EXIT", 50),
    ([(100, 101, 99, 100)], "DATA_MISSING", None),
])
def test_brackets(spark, path, reason, gross):
    bars = candles(spark, [(0, (100, 100, 100, 100)), *enumerate(path, 1)])
    out = events.bracket_outcomes(bars.where("open_time_ms = 0"), bars, 1, 3, 200, 150, bucket=2).first()
    assert out.reason == reason and out.gross_bps == (None if gross is None else pytest.approx(gross))


def test_strict_validation_raises(spark):
    bars = src.bars_1d(spark, SF)
    assert src.validated(bars, src.DAY, "strict").count() == bars.count()
    with pytest.raises(Exception, match="invalid candle"):
        src.validated(bars.withColumn("low", F.lit(-1.0)), src.DAY, "strict").collect()


def test_candles_before_1970_hold_their_trades(spark, tmp_path):
    """Query and SQL agree on ticks on both sides of 1970: each lies between its candle's open and close time."""
    import duckdb

    at = ["1969-12-31 22:30:00", "1969-12-31 23:00:00", "1969-12-31 23:59:59.5", "1970-01-01 00:00:00", "1970-01-01 00:10:00", "1970-01-01 01:00:00"]
    c = duckdb.connect()
    values = ", ".join(f"({i}, TIMESTAMP '{t}', {i}, 'view', {i}.5)" for i, t in enumerate(at))
    c.sql(f"CREATE VIEW events AS SELECT * FROM (VALUES {values}) v(event_id, ts, user_id, event_type, value)")
    c.sql(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value FROM events) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = sorted((r.open_time_ms, r.trade_count) for r in catalog.QUERIES["bars_1h"](spark, str(tmp_path)).collect())
    assert got == [(-7_200_000, 1), (-3_600_000, 2), (0, 2), (3_600_000, 1)]
    assert sorted(c.sql(f"SELECT open_time_ms, trade_count FROM ({catalog.ORACLES['bars_1h']})").fetchall()) == got


def test_streamed_candles_hold_early_ticks_and_those_just_before_the_hour(spark, tmp_path):
    """Stream and SQL agree on ticks less than half a millisecond before the hour, before 1970 too, and on what the last tick has closed."""
    import duckdb

    at = ["1969-12-31 21:00:00", "1969-12-31 22:59:59.9996", "1970-01-01 00:59:59.9999", "1970-01-01 03:10:00", "1970-01-01 05:59:59.9996"]
    c = duckdb.connect()
    values = ", ".join(f"({i}, TIMESTAMP '{t}', {i}, 'view', {i}.5)" for i, t in enumerate(at))
    c.sql(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value FROM (VALUES {values}) v(event_id, ts, user_id, event_type, value)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    closed = [(-10_800_000, 1.5), (-7_200_000, 2.5), (0, 3.5)]
    want = {"streamed_bars": closed, "bars_1h": [*closed, (10_800_000, 4.5), (18_000_000, 5.5)]}
    for name, rows in want.items():
        assert sorted((r.open_time_ms, r.close) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == rows
        assert sorted(c.sql(f"SELECT open_time_ms, close FROM ({catalog.ORACLES[name]})").fetchall()) == rows
