"""Ordered folds over dense series: exact, without gathering a series in one task.

A fold (which trades a portfolio with few places takes, which event of a pattern comes next) is sequential, but its state
soon forgets where it began. So a series is cut into chunks of bounded size and all chunks are folded at once, each from the state
that the chunk before it last ended in (at first from none). Where a chunk's start turns out to have been another, it alone is
folded again. When no start changes any more, every chunk has begun where its predecessor ends, which is the sequential result; a
chunk whose state does not forget its start costs one more round, never a wrong row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.sources.files import kept

#: Rows that a chunk holds, besides those of its last slot.
BOUND = 20_000
#: ``fold(state, rows)``: the state after the rows (None: as before any) and which rows, or what rows, it gives.
Fold = Callable[[tuple | None, Iterable[tuple]], tuple[tuple | None, list]]


def chunked(rows: DataFrame, keys: tuple[str, ...], slot: Column, bound: int = BOUND) -> DataFrame:
    """``rows`` with ``_chunk``: numbers that grow with ``slot`` (whole numbers in time order), each of about ``bound`` rows of a
    key and whole slots. One small row for each key and slot decides."""
    r = rows.withColumn("_slot", slot)
    sizes = r.groupBy(*keys, "_slot").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    return r.join(sizes.select(*keys, "_slot", F.floor(F.coalesce(before, F.lit(0)) / bound).alias("_chunk")), [*keys, "_slot"]).drop("_slot")


def folded(rows: DataFrame, keys: tuple[str, ...], order: list[Column], columns: list[str], state: str, output: str, fold: Fold, frames: bool = False) -> DataFrame:
    """(keys, outputs) of ``fold`` over each key's rows in ``order``. ``rows`` carry ``_chunk`` (from ``chunked``); ``columns`` are what
    the fold reads, as tuples or (``frames``) as one table; ``state`` and ``output`` are the DDL of what it keeps (a struct of arrays and values) and gives."""
    own = [*keys, "_chunk"]
    # rows of a chunk in order, under names of our own
    sorted_ = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*own).orderBy(*order)))
    data = kept(sorted_.select(*own, "_at", *columns), "fold-rows")
    chunks = data.select(*own).distinct()
    kind = lambda cols: ", ".join(f"{c} {data.schema[c].dataType.simpleString()}" for c in cols)
    held = f"struct<{', '.join(': '.join(c.split(' ', 1)) for c in state.split(', '))}>"
    names, fields = [c.split()[0] for c in output.split(", ")], [c.split()[0] for c in state.split(", ")]

    def one(pdf: pd.DataFrame, start: pd.DataFrame) -> tuple[tuple, tuple | None, list]:
        given = None if start.empty or start["_s"].iloc[0] is None else tuple(start["_s"].iloc[0][f] for f in fields)
        pdf = pdf.sort_values("_at")
        end, out = fold(given, pdf[columns] if frames else pdf[columns].itertuples(index=False, name=None))
        return tuple(pdf[c].iloc[0] for c in own), end, out

    def ends(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=[*own, "_e"])
        key, end, _ = one(pdf, start)
        return pd.DataFrame([(*key, None if end is None else dict(zip(fields, end)))], columns=[*own, "_e"])

    def rows_out(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=[*keys, *names])
        key, _, out = one(pdf, start)
        return pd.DataFrame([(*key[:-1], *o) for o in out], columns=[*keys, *names])

    run = lambda some, starts, f, ddl: some.groupBy(*own).cogroup(starts.groupBy(*own)).applyInPandas(f, ddl)
    none = F.lit(None).cast(held)
    # (chunk, its end, the start that it was folded from)
    now = kept(run(data, chunks.withColumn("_s", none), ends, f"{kind(own)}, _e {held}").withColumn("_s", none), "fold-ends")
    before = F.lag("_e").over(Window.partitionBy(*keys).orderBy("_chunk"))  # one row for each chunk
    while True:
        due = kept(now.withColumn("_new", before), "fold-starts")
        wrong = due.where(~F.col("_new").eqNullSafe(F.col("_s"))).select(*own, F.col("_new").alias("_s"))
        if wrong.isEmpty():
            break
        again = run(data.join(wrong.select(*own), own, "left_semi"), wrong, ends, f"{kind(own)}, _e {held}")
        now = kept(due.join(wrong.select(*own), own, "left_anti").select(*own, "_e", "_s").unionByName(again.join(wrong, own).select(*own, "_e", "_s")), "fold-ends")
    return run(data, now.select(*own, "_s"), rows_out, f"{kind(keys)}, {output}")


def _held(open_: dict[str, int]) -> tuple[list[str], list[int]] | None:
    """Open places as a state; none is as before any row."""
    held = sorted(open_.items())
    return ([s for s, _ in held], [int(t) for _, t in held]) if held else None


OPEN = "symbols array<string>, free array<bigint>"


def capacity(trades: DataFrame, keys: tuple[str, ...], id_: str, start: str, until: str, order: list[Column], cap: int, closed: bool = False, slot: Column | None = None, bound: int = BOUND) -> DataFrame:
    """(keys, id) of the trades that a portfolio of ``cap`` places takes in ``order`` (which begins with ``start``): one for each symbol, while
    fewer than ``cap`` are open. A place is free again at ``until``, or (``closed``) only after it.
    ``slot``: whole numbers that grow in ``order`` and hold rows of equal start together; days by default."""
    def fold(state, pdf):
        open_, taken, at = dict(zip(*state)) if state else {}, [], 0
        ids, symbols, begins, ends = (pdf[c].to_numpy() for c in (id_, "symbol", start, until))
        rising = bool((begins[1:] >= begins[:-1]).all())
        freed = lambda begin: {s: t for s, t in open_.items() if t > begin or closed and t == begin}
        while at < len(ids):
            open_ = freed(begins[at])
            if len(open_) >= cap and rising:  # no row is taken before a place is free
                free = begins.searchsorted(min(open_.values()), "right" if closed else "left") if open_ else len(ids)
                at = max(at + 1, int(free))
                continue
            if symbols[at] not in open_ and len(open_) < cap:
                open_[symbols[at]] = ends[at]
                taken.append((ids[at],))
            at += 1
        return _held(freed(begins[-1]) if len(ids) else open_), taken

    cut = chunked(trades, keys, F.floor(F.col(start) / 86_400_000).cast("long") if slot is None else slot, bound)
    kind = trades.schema[id_].dataType.simpleString()
    return folded(cut, keys, order, [id_, "symbol", start, until], OPEN, f"{id_} {kind}", fold, frames=True)


def daily_capped(rows: DataFrame, keys: tuple[str, ...], id_: str, start: str, until: str, order: list[Column], cap: int, day_ms: int = 86_400_000, bound: int = BOUND) -> DataFrame:
    """(keys, id) of the rows taken in ``order``: at most ``cap`` of a key and UTC day, one open at a time for each symbol. Chunks are
    whole days, so only the open symbols pass from one to the next."""
    def fold(state, rows):
        open_, day, n, taken = dict(zip(*state)) if state else {}, None, 0, []
        begin = 0
        for i, symbol, begin, end in rows:
            if begin // day_ms != day:
                day, n = begin // day_ms, 0
            if n < cap and begin >= open_.get(symbol, begin):
                open_[symbol], n = end, n + 1
                taken.append((i,))
        return _held({s: t for s, t in open_.items() if t > begin}), taken

    cut = chunked(rows, keys, F.floor(F.col(start) / day_ms).cast("long"), bound)
    kind = rows.schema[id_].dataType.simpleString()
    return folded(cut, keys, order, [id_, "symbol", start, until], OPEN, f"{id_} {kind}", fold)
