"""File sources and sinks: candle CSV, gzip JSON, JSON-line ledgers, quarantine, retention, idempotent appends."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candela.sources.bars import contiguous_tail, keep_last, violation

DAY = 86_400_000
CANDLE = "open_time_ms long, open double, high double, low double, close double, volume double, quote_volume double, trade_count long, taker_buy_base double, close_time_ms long"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir); a local one only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = Path(tempfile.mkdtemp(prefix="candela-")).as_uri()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read again: what follows starts from files that outlive executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_candle_csv(bars: DataFrame, path: str) -> None:
    """One folder of CSV files for each symbol."""
    bars.write.mode("overwrite").option("header", True).partitionBy("symbol").csv(path)


def read_candle_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every symbol's files in one read; the symbol comes from the file's path."""
    raw = spark.read.schema(CANDLE).option("header", True).option("recursiveFileLookup", True).csv(path)
    return raw.withColumn("symbol", F.regexp_extract(F.col("_metadata.file_path"), "symbol=([^/]+)", 1))


def with_quality(bars: DataFrame, step: int, least: int, most_gaps: float) -> DataFrame:
    """The series of at least ``least`` candles of which at most a share ``most_gaps`` follow a gap."""
    w = Window.partitionBy("symbol").orderBy("open_time_ms")
    gap = F.coalesce(F.col("open_time_ms") - F.lag("open_time_ms").over(w) != step, F.lit(False))
    good = bars.withColumn("_g", gap).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("_g").alias("g")).where((F.col("n") >= least) & (F.col("g") <= F.col("n") * most_gaps))
    return bars.join(good.select("symbol"), "symbol", "left_semi")


def write_array_json(bars: DataFrame, path: str, per_file: int) -> None:
    """Gzip JSON lines {symbol, month, candles: [[o, h, l, c, ct], ...]}: one line for each symbol and ``per_file`` milliseconds."""
    g = bars.groupBy("symbol", F.floor(F.col("open_time_ms") / per_file).alias("part")).agg(F.sort_array(F.collect_list(F.struct("close_time_ms", "open", "high", "low", "close"))).alias("x"))
    arrays = F.transform("x", lambda c: F.array(c.open, c.high, c.low, c.close, c.close_time_ms.cast("double")))
    g.select("symbol", "part", arrays.alias("candles")).write.option("compression", "gzip").json(path)


def read_array_json(spark: SparkSession, path: str) -> DataFrame:
    """Candles from arrays by position."""
    rows = spark.read.schema("symbol string, candles array<array<double>>").json(path).select("symbol", F.explode("candles").alias("c"))
    at = lambda i: F.get("c", F.lit(i))
    return rows.select("symbol", at(0).alias("open"), at(1).alias("high"), at(2).alias("low"), at(3).alias("close"), at(4).cast("long").alias("close_time_ms"))


def read_ledger(spark: SparkSession, path: str, schema: str, name: str, newest: int | None = None, order: str = "settled_ms") -> DataFrame:
    """JSON lines of one schema name; malformed lines and other schemas are skipped; the newest rows only if asked for."""
    rows = spark.read.schema(f"schema string, {schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.where(F.col("_corrupt").isNull() & (F.col("schema") == name)).drop("_corrupt", "schema")
    return rows.orderBy(F.desc(order), "id").limit(newest) if newest else rows


def with_reason(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``reason``: the name of the first rule that does not hold, or null."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(rules.items()):
        reason = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(reason)
    return rows.withColumn("reason", reason)


def split_valid(rows: DataFrame, rules: dict[str, Column], quarantine: str) -> DataFrame:
    """The rows that hold all rules; the others are written to the quarantine with the first rule they break."""
    marked = with_reason(rows, rules)
    marked.where("reason is not null").write.mode("append").parquet(quarantine)
    return marked.where("reason is null").drop("reason")


def parse_payload(rows: DataFrame, cutoff_ms: int) -> DataFrame:
    """Exchange candle rows (JSON arrays of texts) to typed columns: ``problem`` for rows that cannot be cast; candles that close at
    or after the cutoff are still open and go."""
    a = F.from_json("payload", "array<string>")
    kinds = {"open_time_ms": "long", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double", "close_time_ms": "long", "quote_volume": "double", "trade_count": "long", "taker_buy_base": "double"}
    r = rows.withColumn("_a", a).select("symbol", "_a", *[F.get("_a", F.lit(i)).try_cast(k).alias(c) for i, (c, k) in enumerate(kinds.items())])
    bad = F.col("_a").isNull() | (F.size("_a") != len(kinds))
    for c in kinds:
        bad = bad | F.col(c).isNull()
    return r.withColumn("problem", F.when(bad, "payload")).drop("_a").where((F.col("problem").isNotNull()) | (F.col("close_time_ms") < cutoff_ms))


def swap(spark: SparkSession, path: str, made: str) -> None:
    """Put the finished folder ``made`` in the place of ``path``: the old one steps aside, and comes back if the new one cannot take its place.
    Readers of the old files must be done."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    here, new, aside = fs_path(path), fs_path(made), fs_path(f"{path}-old-{uuid.uuid4().hex}")
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(here) and not fs.rename(here, aside):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(new, here):
        if fs.exists(aside):
            fs.rename(aside, here)
        raise OSError(f"cannot move {made} to {path}")
    fs.delete(aside, True)
    spark.catalog.refreshByPath(path)


def append_keep_last(spark: SparkSession, path: str, new: DataFrame, key: tuple[str, ...], order: str) -> int:
    """Union a table on disk with new rows, newest row of each key last; the result is written beside and takes the table's place as a whole. Returns the
    rows added (both counts come from the files' footers)."""
    old = spark.read.parquet(path)
    before = old.count()
    w = Window.partitionBy(*key).orderBy(F.desc("_src"), F.desc(order))
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    made = f"{path}-next-{uuid.uuid4().hex}"
    both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_src").write.parquet(made)
    after = spark.read.parquet(made).count()
    swap(spark, path, made)
    return after - before


def retain(spark: SparkSession, path: str, new: DataFrame, step: int, now_ms: int, days: int) -> DataFrame:
    """The candle sink: old and new candles, validated, newest per time, inside the retention, from the last gap on. The whole table is written beside and
    takes the old one's place, so a symbol without rows left has no partition left. Returns what is on disk then."""
    old = spark.read.parquet(path).select(*new.columns)
    merged = keep_last(old, new).where(violation(step).isNull() & (F.col("open_time_ms") >= now_ms - days * DAY))
    made = f"{path}-next-{uuid.uuid4().hex}"
    contiguous_tail(merged, step).write.partitionBy("symbol").parquet(made)
    swap(spark, path, made)
    return spark.read.parquet(path)


def append_once(spark: SparkSession, path: str, rows: DataFrame, key: tuple[str, ...]) -> None:
    """Append the rows whose key the ledger on disk lacks; a replay adds nothing."""
    have = spark.read.parquet(path).select(*key)
    rows.dropDuplicates(list(key)).join(have, list(key), "left_anti").write.mode("append").parquet(path)


def merge_pending(old: DataFrame, new: DataFrame, key: str, flag: str) -> DataFrame:
    """Insert what is absent; of what is there keep the old payload, and let the flag rise from false to true only."""
    o = old.select(F.col(key), F.struct(*old.columns).alias("o"))
    n = new.dropDuplicates([key]).select(F.col(key), F.struct(*old.columns).alias("n"))
    j = o.join(n, key, "full")
    rest = [F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in old.columns if c not in (key, flag)]
    return j.select(key, *rest, F.greatest(F.coalesce(f"o.{flag}", F.lit(False)), F.coalesce(f"n.{flag}", F.lit(False))).alias(flag))


def missing_ranges(bars: DataFrame, start_ms: int, end_ms: int, covered: DataFrame) -> DataFrame:
    """What a history back to ``start_ms`` lacks: a head before the first candle, unless it was asked for before (``covered``: symbol,
    covered_ms), and a tail after the last one."""
    g = bars.groupBy("symbol").agg(F.min("open_time_ms").alias("first"), F.max("close_time_ms").alias("last")).join(covered, "symbol", "left")
    head = F.when((F.col("first") > start_ms) & (F.col("covered_ms").isNull() | (F.col("covered_ms") > start_ms)), F.struct(F.lit("head").alias("part"), F.lit(start_ms).alias("from_ms"), F.col("first").alias("to_ms")))
    tail = F.when(F.col("last") < end_ms - 1, F.struct(F.lit("tail").alias("part"), (F.col("last") + 1).alias("from_ms"), F.lit(end_ms).alias("to_ms")))
    return g.select("symbol", F.explode(F.array_compact(F.array(head, tail))).alias("r")).select("symbol", "r.*")


def checked_models(models: DataFrame, version: int, now_ms: int, max_age_days: int) -> DataFrame:
    """Model rows of the right version whose numbers are all finite, with ``fresh``; others go."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = (F.col("version") == version) & ok(F.col("intercept")) & F.forall("weights", ok) & (F.size("weights") > 0)
    return models.where(good).withColumn("fresh", F.lit(now_ms) - F.col("trained_ms") <= max_age_days * DAY)


def log_counts(lines: DataFrame, pattern: str = r"(\w+)=(\d+)") -> DataFrame:
    """Counters in log lines: every name=number pair, summed by level and name."""
    level = F.regexp_extract("value", r"^\S+ (\w+) ", 1)
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all("value", F.lit(pattern), F.lit(2)).alias("v"))
    r = lines.select(level.alias("level"), F.explode(pairs).alias("p")).select("level", F.col("p.k").alias("name"), F.col("p.v").cast("long").alias("v"))
    return r.groupBy("level", "name").agg(F.count("*").alias("lines"), F.sum("v").alias("total"))


def symbols_of(raw: DataFrame, column: str, order: str, quote: str = "USDT") -> DataFrame:
    """Normalised, valid symbols without repeats, in the order first seen."""
    s = F.upper(F.trim(column))
    full = F.when(s.endswith(quote), s).otherwise(F.concat(s, F.lit(quote)))
    return raw.select(full.alias("symbol"), F.col(order).alias("at")).where(F.col("symbol").rlike(f"^[A-Z0-9]{{1,20}}{quote}$")).groupBy("symbol").agg(F.min("at").alias("first_seen"))


def contracts(rows: DataFrame, banned: tuple[str, ...] = ("STOCK", "EQUITY", "INDEX", "COMMODITY", "TRADFI"), excluded: tuple[str, ...] = ()) -> DataFrame:
    """Tradable coin perpetuals quoted and margined in USDT, without banned subtypes or excluded symbols, on board."""
    tags = F.coalesce("subtypes", F.array().cast("array<string>"))
    bad = F.exists(tags, lambda t: F.upper(t).rlike("|".join(banned)))
    return rows.where((F.col("status") == "TRADING") & (F.col("kind") == "PERPETUAL") & (F.col("quote") == "USDT") & (F.col("margin") == "USDT") & (F.col("underlying") == "COIN") & ~bad & ~F.col("symbol").isin(*excluded) & (F.col("onboard_ms") > 0))


def manifest_entries(manifest: DataFrame) -> DataFrame:
    """(group, spot, perpetual, strategies, expected) from one row (groups: array of structs, overrides: map)."""
    g = manifest.select("overrides", F.explode("groups").alias("g")).select("overrides", F.col("g.name").alias("group"), F.col("g.strategies").alias("strategies"), F.col("g.expected").alias("expected"), F.explode("g.symbols").alias("spot"))
    return g.select("group", "spot", F.coalesce(F.try_element_at("overrides", F.col("spot")), F.col("spot")).alias("perpetual"), "strategies", "expected")


def manifest_problems(entries: DataFrame) -> DataFrame:
    """Groups of an unexpected size and symbols that come twice; empty for a sound manifest."""
    size = entries.groupBy("group").agg(F.count("*").alias("n"), F.first("expected").alias("e")).where("n <> e").select(F.lit("size").alias("problem"), F.col("group").alias("name"))
    twice = entries.select(F.explode(F.array(F.struct(F.lit("spot").alias("problem"), F.col("spot").alias("name")), F.struct(F.lit("perpetual").alias("problem"), F.col("perpetual").alias("name")))).alias("x")).select("x.*")
    return size.unionByName(twice.groupBy("problem", "name").count().where("count > 1").select("problem", "name"))


def series_hash(bars: DataFrame, row: Column, part_ms: int) -> DataFrame:
    """(symbol, hash): SHA-256 of the hashes of the series' parts of ``part_ms`` each, whose rows (texts, by time) are joined by commas. No row
    holds more than a part, or one hash for each part."""
    part = F.floor(F.col("open_time_ms") / part_ms).alias("part")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x.text), ",")
    parts = bars.groupBy("symbol", part).agg(F.sha2(joined(F.struct("open_time_ms", row.alias("text"))), 256).alias("text"))
    return parts.groupBy("symbol").agg(F.sha2(joined(F.struct("part", "text")), 256).alias("hash"))


def file_manifest(spark: SparkSession, path: str, step: int, schema: str = CANDLE) -> DataFrame:
    """One row for each candle CSV below ``path``: file, symbol (from its folder), bytes, SHA-256 of its content, rows, invalid rows, twice (stamps that
    repeat), segments, longest (stamps of the longest segment, each once), its first and last time, and status: SKIP_DUPLICATE, SKIP_NO_VALID_BARS, SELECTED (the
    symbol's longest, then first by name) or AVAILABLE. A file is hashed where it is read; its content never leaves its task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path)
    files = files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    raw = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path).withColumn("file", F.col("_metadata.file_path"))
    r = raw.withColumns({"symbol": F.regexp_extract("file", "symbol=([^/]+)", 1)})
    names = {c.split()[0] for c in schema.split(", ")}
    good = violation(step).isNull() if {"high", "volume"} <= names else F.col("open_time_ms").isNotNull() & (F.col("open_time_ms") % step == 0)
    w = Window.partitionBy("file").orderBy("open_time_ms")
    r = r.withColumns({"good": good, "twice": F.count("*").over(Window.partitionBy("file", "open_time_ms")) > 1})
    g = r.groupBy("file", "symbol").agg(F.count("*").alias("rows"), F.count_if(~F.coalesce("good", F.lit(False))).alias("invalid"), F.count_if("twice").alias("twice"))
    s = r.where("good").dropDuplicates(["file", "open_time_ms"]).withColumn("gap", F.coalesce((F.col("open_time_ms") - F.lag("open_time_ms").over(w) != step).cast("int"), F.lit(0)))
    s = s.withColumn("segment", F.sum("gap").over(w)).groupBy("file", "segment").agg(F.count("*").alias("n"), F.min("open_time_ms").alias("a"), F.max("open_time_ms").alias("b"))
    s = s.groupBy("file").agg(F.count("*").alias("segments"), F.max(F.struct("n", (-F.col("a")).alias("z"), "b")).alias("m"))
    j = g.join(s, "file", "left").select("file", "symbol", "rows", "invalid", "twice", F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("m.n", F.lit(0)).alias("longest"), (-F.col("m.z")).alias("start_ms"), F.col("m.b").alias("end_ms"))
    usable = (F.col("twice") == 0) & (F.col("longest") > 0)
    best = F.row_number().over(Window.partitionBy("symbol").orderBy(usable.desc(), F.desc("longest"), "file"))
    status = F.when(F.col("twice") > 0, "SKIP_DUPLICATE").when(F.col("longest") == 0, "SKIP_NO_VALID_BARS").when(best == 1, "SELECTED").otherwise("AVAILABLE")
    return j.withColumn("status", status).join(files, "file")


def read_pending(spark: SparkSession, path: str, schema: str, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """A folder of JSON records, in any files below it: the valid rows, and the others with ``file``, ``raw`` text and ``problem``: json (not readable as the schema says) or
    the first rule that fails or is unknown."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    kind = f"{schema}, _bad string"
    r = raw.withColumn("j", F.from_json("value", kind, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    names = [c.split()[0] for c in schema.split(", ")]
    flat = r.select("file", "value", F.col("j._bad").alias("_bad"), *[F.col(f"j.{c}").alias(c) for c in names])
    problem = F.when(F.col("_bad").isNotNull() | F.col(names[0]).isNull(), "json")
    for name, rule in rules.items():
        problem = problem.when(~F.coalesce(rule, F.lit(False)), name)
    flat = flat.withColumn("problem", problem)
    return flat.where("problem is null").select(*names), flat.where("problem is not null").select("file", F.col("value").alias("raw"), "problem")
