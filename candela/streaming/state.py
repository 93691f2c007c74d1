"""Keyed state over streams: one step function for each machine, run as a stateful stream (transformWithState, with timers that
remove what no longer matters) or, for replays, as an ordered batch fold in chunks. A key's state is a few values; rows of a batch are taken
in time order."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from candela.operators import folds
from candela.sources.files import scratch

Step = Callable[[tuple | None, tuple], tuple[tuple, tuple | None]]
#: The state store that timers and typed state need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
VALUE = "value"


def run_parts(spark: SparkSession, parts: list[DataFrame], machine: Callable[[DataFrame], DataFrame], name: str, out: str | None = None) -> DataFrame:
    """The rows of a machine over parts that arrive one after the other: each is appended to the source folder and taken by a run
    that starts anew from the checkpoint of the one before, so state, watermark and offsets outlive every restart."""
    for k, v in STORE.items():
        spark.conf.set(k, v)
    path, out = scratch(spark, f"{name}-source"), out or scratch(spark, name)
    made = None
    for p in parts:
        p.write.mode("append").parquet(path)
        made = machine(spark.readStream.schema(parts[0].schema).parquet(path))
        made.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{out}/rows")


def state_rows(spark: SparkSession, out: str, operator_id: int = 0) -> DataFrame:
    """What the state store of a run of ``run_parts`` still holds; a bucket gives one row for each of its members, keyed by their id."""
    rows = spark.read.format("statestore").option("operatorId", operator_id).option("stateVarName", VALUE).load(f"{out}/progress")
    if "bucket" not in rows.schema["key"].dataType.names:
        return rows
    own = rows.select("partition_id", F.explode(F.arrays_zip("value.id", "value.due", "value.done")).alias("value"))
    return own.select(F.struct(F.col("value.id").alias("id")).alias("key"), "value", "partition_id")


def _run(rows, state: tuple | None, step: Step) -> tuple[tuple | None, list[tuple]]:
    out = []
    for row in rows:
        state, made = step(state, row)
        if made is not None:
            out.append(made)
    return state, out


class Machine(StatefulProcessor):
    """A step function over a key's rows. ``until(state)``: the event time (ms) from which the state has no effect any more; a timer
    removes it then. Without it the state stays."""

    def __init__(self, key: str, columns: list[str], order: str, step: Step, names: list[str], state: str, until: Callable[[tuple], int] | None = None):
        self.key, self.columns, self.order, self.step, self.names, self.schema, self.until = key, columns, order, step, names, state, until

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState(VALUE, self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(rows).sort_values(self.order, kind="stable")
        now, out = _run(pdf[self.columns].itertuples(index=False, name=None), tuple(self.held.get()) if self.held.exists() else None, self.step)
        if now is not None:
            self.held.update(now)
            if self.until:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(int(self.until(now)))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=[self.key, *self.names])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame([], columns=[self.key, *self.names])

    def close(self) -> None:
        pass


def folded(rows: DataFrame, key: str, columns: list[str], order: str, step: Step, output: str, state: str, until: Callable[[tuple], int] | None = None) -> DataFrame:
    """(key, outputs of ``step``) for a stream or a batch. ``step(state or None, row)`` gives the next state and a row or None.
    A stream with ``until`` needs a watermark. A batch is folded in chunks of days of ``order`` (milliseconds), so a long series is no one task."""
    names = [c.split()[0] for c in output.split(", ")]
    if rows.isStreaming:
        schema = f"{key} {rows.schema[key].dataType.simpleString()}, {output}"
        return rows.groupBy(key).transformWithStateInPandas(Machine(key, columns, order, step, names, state, until), schema, "append", "EventTime" if until else "None")
    cut = folds.chunked(rows, (key,), F.floor(F.col(order) / 86_400_000).cast("long"))
    return folds.folded(cut, (key,), [F.col(order)], columns, state, output, lambda s, some: _run(some, s, step))


CALM = ("OFF", "TRANSITION")


def regime_moves(enter: int = 3, leave: int = 2) -> dict[tuple[bool, str], tuple[str, int]]:
    """(is it BULL now, class of the bar): the state that the bar speaks for and how many such bars in a row it takes. "calm" is OFF or
    TRANSITION, by the bar's score."""
    stay = {(True, c): ("BULL", leave) for c in ("strong", "hold")}
    fail = {(True, "weak"): ("calm", leave), (False, "weak"): ("calm", leave), (False, "hold"): ("calm", leave)}
    return {**stay, **fail, (False, "strong"): ("BULL", enter), (True, "severe"): ("calm", 1), (False, "severe"): ("calm", 1)}


Test = tuple[str, str, float]
COMPARE = {"<": operator.lt, "<=": operator.le, ">=": operator.ge}


def regime_classes(entry: float) -> list[tuple[str, Callable[..., bool], list[Test]]]:
    """The classes of a healthy bar, first that holds: name, whether any or all of its tests must hold, the tests. The hold band reaches ten
    points below the entry, down to 35 % at least."""
    major = [("persistent_up", ">=", 1), ("trend_fraction", ">=", 0.75)]
    return [("severe", any, [("breadth", "<", 0.35), ("trend_fraction", "<=", 0.25)]), ("strong", all, [*major, ("breadth", ">=", entry)]),
            ("hold", all, [*major, ("breadth", ">=", max(0.35, entry - 0.10))]), ("weak", all, [])]


def regime_sql(entry: float = 0.60, enter: int = 3, leave: int = 2) -> tuple[str, str, str]:
    """SQL of the same tables: a bar's class, and from ``base`` and ``class`` the target (with ``calm`` the score's state) and how many bars it takes."""
    text = lambda how, tests: (" OR " if how is any else " AND ").join(f"CAST({c} AS DOUBLE) {o} {v}" for c, o, v in tests) or "TRUE"
    kind = " ".join(f"WHEN {text(how, tests)} THEN '{name}'" for name, how, tests in regime_classes(entry))
    when = lambda pick: " ".join(f"WHEN (base = 'BULL') = {str(bull).upper()} AND class = '{c}' THEN {pick(*to)}" for (bull, c), to in regime_moves(enter, leave).items())
    return f"CASE {kind} END", f"CASE {when(lambda t, n: 'calm' if t == 'calm' else repr(t))} END", f"CASE {when(lambda t, n: n)} END"


def confirmed(now: str, wish: str, count: int, target: str, needed: int) -> tuple[str, str, int]:
    """The state, and the wish with its count, after a bar that speaks for ``target``. While BULL fails, OFF and TRANSITION are one wish."""
    if target == now:
        return now, "", 0
    alike = wish == target or now == "BULL" and wish in CALM
    count = 1 + count * alike
    return (target, "", 0) if count >= needed else (now, target, count)


def regime_step(step_ms: int, entry: float = 0.60, enter: int = 3, leave: int = 2):
    """The confirmed market regime. Rows: ``REGIME_IN``. State: regime, wish, count, time of the last bar.

    A bar moves the regime by ``regime_moves``. A gap, or missing health, makes it UNKNOWN and it must be earned anew; wishes are
    counted over neighbouring bars only. A bar that came before changes nothing, an older one reads UNKNOWN. A machine begins in the raw
    state, BULL being TRANSITION until it is confirmed.
    """
    moves, classes = regime_moves(enter, leave), regime_classes(entry)

    def step(state, row):
        bar = dict(zip(REGIME_IN, row))
        t, raw = int(bar["open_time_ms"]), bar["state"]
        healthy = bool(bar["healthy"]) and raw in ("BULL", *CALM)
        old, wish, count, last = state or ((raw if raw in CALM else "TRANSITION") if healthy else "UNKNOWN", "", 0, None)
        ahead = None if last is None else (t - last) / step_ms
        if ahead is not None and (ahead < 0 or ahead == 0 and healthy):
            return state, (t, raw, old if ahead == 0 else "UNKNOWN", None)
        if not healthy:
            new, wish, count = "UNKNOWN", "", 0
        else:
            now = "UNKNOWN" if ahead is not None and ahead > 1 else old
            wish, count = (wish, count) if ahead == 1 else ("", 0)
            kind = next(name for name, how, tests in classes if how(COMPARE[o](bar[c], v) for c, o, v in tests))
            target, needed = moves[now == "BULL", kind]
            new, wish, count = confirmed(now, wish, count, ("OFF" if bar["score"] < 0.55 else "TRANSITION") if target == "calm" else target, needed)
        return (new, wish, count, t), (t, raw, new, f"{old}>{new}" if state and new != old else None)

    return step


REGIME_OUT, REGIME_STATE = "open_time_ms long, raw string, regime string, event string", "regime string, wish string, count long, last long"
REGIME_IN = ["open_time_ms", "state", "score", "breadth", "trend_fraction", "persistent_up", "healthy"]


def regimes(rows: DataFrame, step_ms: int, **limits) -> DataFrame:
    """(policy, time, raw, regime, event) by policy key: another policy is another machine."""
    return folded(rows, "policy", REGIME_IN, "open_time_ms", regime_step(step_ms, **limits), REGIME_OUT, REGIME_STATE)


def append_step(step_ms: int):
    """One contiguous candle after another: APPEND; a candle seen or older: dropped; after a gap: GAP with the candles to fetch."""

    def step(state, row):
        t = int(row[0])
        if state is not None and t <= state[0]:
            return state, None
        gap = 0 if state is None else (t - state[0]) // step_ms - 1
        return (t,), (t, "GAP" if gap else "APPEND", int(gap))

    return step


def appended(candles: DataFrame, step_ms: int) -> DataFrame:
    return folded(candles, "symbol", ["open_time_ms"], "open_time_ms", append_step(step_ms), "open_time_ms long, action string, missing long", "last long")


def delivery_step(cooldown_ms: int, better: float):
    """Send unless the last delivery of the key is too recent and the score is not better by ``better``. Only deliveries count."""

    def step(state, row):
        t, i, score = int(row[0]), int(row[1]), float(row[2])
        if state is not None and t - state[0] < cooldown_ms and score < state[1] + better:
            return state, (t, i, "COOLDOWN")
        return (t, score), (t, i, "SENT")

    return step


def deliveries(signals: DataFrame, cooldown_ms: int, better: float) -> DataFrame:
    """Signals (key, t, id, score), each id once. A key's last delivery is forgotten when event time has passed its cooldown."""
    once = signals.withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["id"]) if signals.isStreaming else signals.dropDuplicates(["id"])
    return folded(once, "key", ["t", "id", "score"], "t", delivery_step(cooldown_ms, better), "t long, id long, action string", "sent long, score double", lambda s: s[0] + cooldown_ms)


def incident_step(repeat_ms: int, failures: int):
    """A check's incident is due after so many failures in a row, and again only after the repeat time."""

    def step(state, row):
        t, bad = int(row[0]), bool(row[1])
        n, sent = state or (0, -(1 << 60))
        n = n + 1 if bad else 0
        due = n >= failures and t - sent >= repeat_ms
        return (n, t if due else sent), ((t, n) if due else None)

    return step


def incidents(checks: DataFrame, repeat_ms: int, failures: int = 3) -> DataFrame:
    return folded(checks, "code", ["t", "bad"], "t", incident_step(repeat_ms, failures), "t long, failures long", "n long, sent long")


#: Setups share this many groups: a group costs Python calls and a state of its own, a setup only a row.
BUCKETS = 1024


class Lifecycles(StatefulProcessor):
    """The setups of a bucket from open to settled, as one value of arrays. Its timer, at the earliest deadline and the grace time, reports what has not
    settled by then as missing and removes it; what settled is remembered until then too, so that a repeated touch settles nothing twice."""

    def __init__(self, grace_ms: int):
        self.grace = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState(VALUE, "id array<bigint>, due array<bigint>, done array<boolean>")

    def _setups(self) -> dict[int, tuple[int, bool]]:
        return {i: (due, done) for i, due, done in zip(*self.held.get())} if self.held.exists() else {}

    def _keep(self, setups: dict[int, tuple[int, bool]]) -> None:
        if setups:
            self.held.update((list(setups), [due for due, _ in setups.values()], [done for _, done in setups.values()]))
            self.handle.registerTimer(min(due for due, _ in setups.values()) + self.grace + 1)  # timers fire at their time, not after it
        else:
            self.held.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        setups = self._setups()
        made, known = [], {i: due for i, (due, _) in setups.items()}
        pdf = pd.concat(rows).sort_values("t", kind="stable")
        for i, t, kind, until in pdf[["id", "t", "kind", "due"]].itertuples(index=False, name=None):
            i = None if i is None or i != i else int(i)
            due, done = setups.get(i, (None, False))
            if kind == "open" and known.get(i) is None:
                due = known[i] = int(until)
            elif kind == "touch":
                due = int(t) if due is None else due
                if not done:
                    made.append((i, "SETTLED", int(t)))
                done = True
            setups[i] = due, done
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self._keep(setups)
        yield pd.DataFrame(made, columns=["id", "status", "t"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, setups = timerValues.getCurrentWatermarkInMs(), self._setups()
        over = {i: s for i, s in setups.items() if s[0] + self.grace < now}
        self._keep({i: s for i, s in setups.items() if i not in over})
        yield pd.DataFrame([(i, "DATA_MISSING", due) for i, (due, done) in over.items() if not done], columns=["id", "status", "t"])

    def close(self) -> None:
        pass


def lifecycles(events: DataFrame, grace_ms: int) -> DataFrame:
    """Setups (id, at, t, kind, due) from open to SETTLED at their touch, or DATA_MISSING when event time passes the deadline and the
    grace time without one. No state outlives that time."""
    rows = events.withWatermark("at", "0 seconds").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").transformWithStateInPandas(Lifecycles(grace_ms), "id long, status string, t long", "append", "EventTime")


def latest_closed(lines: DataFrame, path: str) -> None:
    """Closed candles from a stream of JSON lines: the newest of each symbol, rewritten after every batch."""
    kind = "symbol string, open_time_ms long, close double, closed boolean"
    typed = lines.select(F.from_json("value", kind).alias("c")).select("c.*").where("closed")
    newest = typed.groupBy("symbol").agg(F.max_by(F.struct("open_time_ms", "close"), "open_time_ms").alias("c"))
    sink = lambda batch, _: batch.select("symbol", "c.*").write.mode("overwrite").parquet(path + "/rows")
    newest.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", path + "/progress").trigger(availableNow=True).start().awaitTermination()


def whole_windows(candles: DataFrame, hours: int, late: str = "0 seconds") -> DataFrame:
    """Coarser candles from a stream of hourly ones, emitted when the watermark passes and every hour is there."""
    g = candles.withWatermark("at", late).groupBy("symbol", F.window("at", f"{hours} hours").alias("w")).agg(F.min_by("open", "at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "at").alias("close"), F.count("*").alias("n"))
    return g.where(F.col("n") == hours).select("symbol", F.unix_millis("w.start").alias("bucket_ms"), "open", "high", "low", "close")
