"""Measures over a signal ledger: cohorts, forecasts, assessments, scorecards, gates and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.scalars import ratio, wilson
from candela.operators import folds

DAY = 86_400_000


def finite(x: Column) -> Column:
    """A number, or null for what is no finite number."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def deadline(source_ms: Column, hours: Column) -> Column:
    """Source plus horizon, null if either is missing or not positive."""
    return F.when((finite(source_ms) > 0) & (finite(hours) > 0), (finite(source_ms) + finite(hours) * 3_600_000).cast("long"))


def signal_id(*parts: Column) -> Column:
    """SHA-256, in hex, of the parts joined by a bar."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def short_net(gross: Column, long_net: Column) -> Column:
    """A short's net from a long ledger row: the implied cost is paid again."""
    return -gross - F.greatest(gross - long_net, F.lit(0.0))


COHORT = ("audience", "horizon", "direction", "regime", "strategy", "policy", "symbol", "family")


def cohorts(ledger: DataFrame, now_ms: int, complete: bool = True) -> DataFrame:
    """Maturity-aware cohorts. A row counts for all its families and for its audiences (all, and notified or muted). Rates are
    given only where something is resolved and nothing is missing or of unknown deadline; net figures only with every net known."""
    audience = F.array(F.lit("all"), F.when(F.coalesce("notified", F.lit(False)), "notified").otherwise("muted"))
    families = F.when(F.size("families") > 0, F.col("families")).otherwise(F.array(F.lit("Unknown")))
    r = ledger.withColumn("audience", F.explode(audience)).withColumn("family", F.explode(F.array_distinct(families)))
    due = deadline(F.col("bar_ms"), F.col("horizon") / 60)
    r = r.withColumns({"due": due, "settled": F.col("status").isin("TARGET", "STOP", "TIME_EXIT"), "won": F.col("status") == "TARGET"})
    mature, open_ = F.col("due") <= now_ms, F.col("due") > now_ms
    done = mature & F.coalesce("settled", F.lit(False))
    g = r.groupBy(*COHORT).agg(
        F.count("*").alias("records"), F.count_if(mature).alias("matured"), F.count_if(done).alias("resolved"), F.count_if(open_).alias("open"), F.count_if(F.col("due").isNull()).alias("unknown_deadline"),
        F.count_if(open_ & F.col("settled") & F.col("won")).alias("early_hits"), F.count_if(done & F.col("won")).alias("hits"), F.count_distinct(F.when(done, F.floor(F.col("bar_ms") / DAY))).alias("days"),
        F.count_if(done & (F.col("status") == "STOP")).alias("stops"), F.count_if(done & (F.col("status") == "TIME_EXIT")).alias("time_exits"), F.count_if(done & F.col("net").isNotNull()).alias("net_n"),
        F.count_if(done & (F.col("net") > 0)).alias("net_wins"), F.avg(F.when(done, F.col("net"))).alias("mean"))
    ready = (F.col("resolved") > 0) & (F.col("matured") == F.col("resolved")) & (F.col("unknown_deadline") == 0) & F.lit(complete)
    full = ready & (F.col("net_n") == F.col("resolved"))
    low, high = wilson(F.col("hits"), F.col("resolved"))
    return g.withColumns({"missing": F.col("matured") - F.col("resolved"), "misses": F.col("resolved") - F.col("hits"), "hit_rate": F.when(ready, F.col("hits") / F.col("resolved")), "low": F.when(ready, low), "high": F.when(ready, high),
                          "net_win_rate": F.when(full, F.col("net_wins") / F.col("net_n")), "mean_net": F.when(full, F.col("mean"))}).drop("mean")


LEVELS = (("symbol", "regime"), ("regime",), ())


def forecasts(items: DataFrame, ledger: DataFrame, least: int = 10) -> DataFrame:
    """For each item (symbol, regime, family) and horizon: rows, share of gross > 0, median gross and net, from the family's rows of the
    same symbol and regime if there are ``least``, else of the regime, else all. Three small aggregates meet the items."""
    net = F.coalesce("net", F.col("gross") - F.coalesce("cost", F.lit(0.0)), "gross")
    rows = ledger.where("gross is not null").withColumn("n_", net)
    j = items.withColumn("horizon", F.explode(F.array(F.lit(15), F.lit(30), F.lit(60))))
    for i, keys in enumerate(LEVELS):
        g = rows.groupBy("family", "horizon", *keys).agg(F.count("*").alias(f"n{i}"), F.avg((F.col("gross") > 0).cast("double")).alias(f"p{i}"), F.percentile("gross", 0.5).alias(f"g{i}"), F.percentile("n_", 0.5).alias(f"t{i}"))
        j = j.join(g, ["family", "horizon", *keys], "left")
    level = F.when(F.col("n0") >= least, 0).when(F.col("n1") >= least, 1).otherwise(2)
    take = lambda c: F.when(F.col("level") == 0, F.col(f"{c}0")).when(F.col("level") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    return j.withColumn("level", level).select(*items.columns, "horizon", "level", take("n").alias("n"), take("p").alias("p_up"), take("g").alias("median_gross"), take("t").alias("median_net")).where("n is not null")


def direction_of(p_up: Column, gross: Column, net: Column) -> Column:
    """UP, DOWN or MIXED from a share of rises and the median moves."""
    return F.when((p_up >= 0.55) & (net > 0), "UP").when((p_up <= 0.45) & (short_net(gross, net) > 0), "DOWN").otherwise("MIXED")


def setup_directions(forecast: DataFrame, *setup: str) -> DataFrame:
    """Each setup's label by horizon from its families' forecasts weighted by rows, and the consensus: UP or DOWN where every
    horizon known agrees; ``families_agree`` is false where families of one horizon differ."""
    r = forecast.withColumn("label", direction_of(F.col("p_up"), F.col("median_gross"), F.col("median_net")))
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    g = r.groupBy(*setup, "horizon").agg(F.sum("n").alias("n"), mean("p_up").alias("p_up"), mean("median_gross").alias("gross"), mean("median_net").alias("net"), F.count_distinct("label").alias("kinds"))
    g = g.withColumn("label", direction_of(F.col("p_up"), F.col("gross"), F.col("net")))
    one = F.collect_set("label")
    return g.groupBy(*setup).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("horizon", "label"))), lambda x: x.label), "/").alias("labels"), (F.max("kinds") == 1).alias("families_agree"),
                                 F.when(F.size(one) == 1, F.element_at(one, 1)).otherwise("MIXED").alias("direction"))


HORIZON_OF = {"BULL_CONTINUATION_LONG": 60, "BULL_EXHAUSTION_SHORT": 30, "FLUSH_RECOVERY_LONG": 60, "DOWNSIDE_CONTINUATION_SHORT": 30, "DIRECTIONAL_LONG": 60, "DIRECTIONAL_SHORT": 60}


def assessments(items: DataFrame, ledger: DataFrame, least: int = 10) -> DataFrame:
    """Items (id, symbol, regime, families, up, strategy) judged at their strategy's fixed horizon. Rows of all the item's families,
    each from its own fallback level, count once per (symbol, bar) with the least favourable directed net; P = (wins + 1) / (n + 2).

    Histories travel as one row for each family, level key and event, joined on the chosen level's key only."""
    horizon = F.coalesce(*[F.when(F.col("strategy") == k, F.lit(v)) for k, v in HORIZON_OF.items()])
    one = items.withColumn("horizon", horizon).withColumn("family", F.explode("families"))
    rows = ledger.where("gross is not null")
    for i, keys in enumerate(LEVELS[:2]):
        one = one.join(rows.groupBy("family", "horizon", *keys).agg(F.count("*").alias(f"n{i}")), ["family", "horizon", *keys], "left")
    key = lambda level, symbol, regime: F.when(level == 0, F.concat_ws("|", F.lit("0"), symbol, regime)).when(level == 1, F.concat_ws("|", F.lit("1"), regime)).otherwise(F.lit("2"))
    one = one.withColumn("at", key(F.when(F.col("n0") >= least, 0).when(F.col("n1") >= least, 1).otherwise(2), F.col("symbol"), F.col("regime"))).select("id", "up", "family", "horizon", "at")
    history = rows.withColumn("l", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select("family", "horizon", key(F.col("l"), F.col("symbol"), F.col("regime")).alias("at"), F.col("symbol").alias("s"), "bar_ms", "gross", "cost", "settled_ms")
    net = F.when(F.col("up"), F.col("gross") - F.col("cost")).otherwise(-F.col("gross") - F.col("cost"))
    events = one.join(history, ["family", "horizon", "at"]).groupBy("id", "s", "bar_ms").agg(F.min(net).alias("net"), F.collect_set(F.floor(F.col("settled_ms") / DAY)).alias("days"))
    g = events.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("net") > 0).alias("wins"), F.avg("net").alias("expected_net"), F.size(F.array_distinct(F.flatten(F.collect_list("days")))).alias("days"))
    confidence = F.when((F.col("n") < 30) | (F.col("days") < 3), "LOW").when((F.col("n") < 100) | (F.col("days") < 10), "MID").otherwise("HIGH")
    return g.select("id", "n", "days", ((F.col("wins") + 1) / (F.col("n") + 2)).alias("probability"), "expected_net", confidence.alias("confidence"))


def quality_percentiles(items: DataFrame, ledger: DataFrame, least: int = 10, steps: int = 16) -> DataFrame:
    """id and percentile: the share of the family's and regime's past scores at or below an item's, averaged over the item's families that
    have at least ``least`` of them (null if none has). Items: id, families, regime, score, which need not be a past score.

    Looked up as of the score: scores fall into ``steps`` slots a point; slots are summed up first, and inside a slot items run over the
    ledger's rows in order. So a family's rows are spread over its slots, whatever their number.
    """
    keys = ["family", "regime"]
    slot = F.floor(F.col("score") * steps).alias("slot")
    past = ledger.where(F.col("score").isNotNull() & ~F.isnan("score")).select(*keys, "score", slot, F.lit(None).cast(items.schema["id"].dataType).alias("id"), F.lit(1).alias("past"))
    ask = items.select(F.explode(F.array_distinct("families")).alias("family"), "regime", "score", slot, "id", F.lit(0).alias("past"))
    both = past.unionByName(ask.select(*keys, "score", "slot", "id", "past"))
    slots = both.groupBy(*keys, "slot").agg(F.sum("past").alias("n"))
    w = Window.partitionBy(*keys).orderBy("slot")  # one row for each slot
    slots = slots.withColumns({"before": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(Window.partitionBy(*keys))})
    inside = F.sum("past").over(Window.partitionBy(*keys, "slot").orderBy("score").rangeBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("upto", inside).where("past = 0").join(slots.drop("n"), [*keys, "slot"])
    share = F.when(F.col("total") >= least, (F.col("before") + F.col("upto")) / F.col("total"))
    return items.select("id").distinct().join(found.groupBy("id").agg(F.avg(share).alias("percentile")), "id", "left")


def scorecard_days(ledger: DataFrame, now_ms: int, days: int, tiers: tuple[str, ...]) -> DataFrame:
    """Overall, by tier and by model (symbol and horizon) over the last ``days``: rows, hit rate, mean gross and net, total net.
    Tiers without rows are zeros."""
    r = ledger.where((F.col("status").isNotNull()) & (F.lit(now_ms) - F.col("settled_ms") <= days * DAY)).withColumns({"tier": F.when(F.col("notified"), tiers[0]).otherwise(tiers[1]), "model": F.concat_ws("_", "symbol", F.col("horizon").cast("string")), "overall": F.lit("all")})
    measure = [F.count("*").alias("n"), F.avg((F.col("status") == "TARGET").cast("double")).alias("hit_rate"), F.avg("gross").alias("gross"), F.avg("net").alias("net"), F.sum("net").alias("total_net")]
    g = r.groupingSets([["overall"], ["tier"], ["model"]], "overall", "tier", "model").agg(F.coalesce("overall", "tier", "model").alias("group"), *measure)
    kind = F.when(F.col("overall").isNotNull(), "overall").when(F.col("tier").isNotNull(), "tier").otherwise("model")
    spark = ledger.sparkSession
    zeros = spark.createDataFrame([("tier", t) for t in tiers], "kind string, group string")
    out = g.select(kind.alias("kind"), "group", "n", "hit_rate", "gross", "net", "total_net")
    missing = zeros.join(out, ["kind", "group"], "left_anti").select("kind", "group", F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(c) for c in ("hit_rate", "gross", "net", "total_net")])
    return out.unionByName(missing)


def family_scorecard(ledger: DataFrame) -> DataFrame:
    """Outcomes by family and horizon, by regime, by strategy and overall, of the policy of the newest bar only."""
    newest = ledger.agg(F.max_by("policy", F.struct("bar_ms", "id")).alias("policy"))
    r = ledger.join(F.broadcast(newest), "policy")  # one row
    return r.groupingSets([["family", "horizon"], ["regime"], ["strategy"], []], "family", "horizon", "regime", "strategy").agg(
        F.count_distinct("id").alias("signals"), F.count("status").alias("outcomes"), F.count_if(F.col("status").isNull()).alias("missing"), F.count_if("notified").alias("notified"), F.count_if(F.col("status") == "TARGET").alias("hits"), F.sum("net").alias("total_net"))


def execution(ledger: DataFrame, fee: float = 4.0, slip: float = 1.0, base_cost: float = 12.0, spread: float = 8.0, volume: float = 1_000_000, funding: float = 15.0, volatility: float = 100.0) -> DataFrame:
    """Estimated cost, eligibility, tier and the list of reasons against each signal. Without a snapshot the base cost holds and
    nothing is eligible."""
    known = F.col("spread_bps").isNotNull()
    cost = F.when(known, F.greatest(F.lit(base_cost), 2 * fee + F.col("spread_bps") + 2 * slip)).otherwise(base_cost)
    bad = {"spread": F.col("spread_bps") > spread, "liquidity": F.coalesce(F.col("quote_volume") < volume, F.lit(True)), "funding": F.coalesce(F.abs("funding_bps") > funding, F.lit(True)), "volatility": F.coalesce(F.col("volatility_bps") > volatility, F.lit(True))}
    reasons = F.when(~known, F.array(F.lit("market_data_missing"))).otherwise(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in bad.items()])))
    r = ledger.withColumns({"estimated_cost": cost, "reasons": reasons}).withColumn("eligible", F.size("reasons") == 0)
    setup = (F.size("families") >= 2) | F.arrays_overlap("families", F.array(F.lit("B2"), F.lit("B4")))
    return r.withColumn("tier", F.when(F.col("eligible") & setup & F.col("regime").isin("BULL", "TRANSITION"), "SETUP").otherwise("RADAR"))


REASONS = ("regime_silent", "off_disabled", "transition_disabled", "shadow_only_family", "market_data_missing", "spread", "liquidity", "funding", "volatility", "no_setup", "calibration_missing", "probability_low", "expected_net_low", "quality_low", "score_low", "eligible")


def notification_reasons(candidates: DataFrame, thresholds: DataFrame, live: tuple[str, ...], samples: int = 30) -> DataFrame:
    """Candidates (regime, family, families, tier, reasons, n, probability, expected_net, percentile, score) with ``why``: the first
    gate that fails, where market-data reasons may be several, or ``eligible``. ``thresholds`` (regime, enabled, score, percentile,
    probability, net) has one row for each regime; none is looser than BULL's."""
    base = thresholds.where("regime = 'BULL'").select(*[F.col(c).alias(f"b_{c}") for c in ("score", "percentile", "probability", "net")])
    limits = thresholds.crossJoin(F.broadcast(base)).select("regime", "enabled", *[F.greatest(c, f"b_{c}").alias(f"least_{c}") for c in ("score", "percentile", "probability", "net")])
    r = candidates.join(F.broadcast(limits), "regime", "left")  # one row for each regime
    calibrated = F.coalesce(F.col("n") >= samples, F.lit(False)) & F.lit(samples > 0)
    off = F.when(F.col("regime") == "OFF", "off_disabled").when(F.col("regime") == "TRANSITION", "transition_disabled").otherwise("regime_silent")
    alone = lambda x: F.array(F.lit(x))
    why = (F.when(~F.coalesce("enabled", F.lit(False)), F.array(off)).when(~F.arrays_overlap("families", F.array(*map(F.lit, live))), alone("shadow_only_family"))
           .when(F.size("reasons") > 0, F.col("reasons")).when(F.col("tier") != "SETUP", alone("no_setup"))
           .when(calibrated & (F.col("probability").isNull() | F.col("expected_net").isNull()), alone("calibration_missing"))
           .when(calibrated & (F.col("probability") < F.col("least_probability")), alone("probability_low")).when(calibrated & (F.col("expected_net") < F.col("least_net")), alone("expected_net_low"))
           .when(calibrated & F.col("percentile").isNull() & (F.col("score") < F.col("least_score")), alone("score_low")).when(calibrated & (F.col("percentile") < F.col("least_percentile")), alone("quality_low"))
           .when(~calibrated & (F.col("score") < F.col("least_score")), alone("score_low")).otherwise(alone("eligible")))
    return r.withColumn("why", why)


def reason_counts(judged: DataFrame) -> DataFrame:
    """Counts for every reason, zeros too."""
    names = judged.sparkSession.createDataFrame([(x,) for x in REASONS], "reason string")
    g = judged.select(F.explode("why").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return names.join(g, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def safety(candidates: DataFrame, ledger: DataFrame, sent: DataFrame, now_ms: int, kill: bool, most_open: int, loss_limit: float, cooldown_ms: int, better: float) -> DataFrame:
    """Candidates (id, symbol, direction, score) with ``blocked``: the kill switch, too many open alerts (those not settled yet, each
    for at most an hour), the day's loss limit (none unless positive), or the same direction too soon after the last delivery (sent: symbol, direction, score, sent_ms)
    unless the score is better by ``better``. Null if it may go."""
    day = now_ms - now_ms % DAY
    open_until = F.col("bar_ms") + F.least("horizon", F.lit(60)) * 60_000
    told = ledger.where("notified")
    pending = F.col("status").isNull() | (F.col("settled_ms") > now_ms)
    totals = told.agg(F.count_if(pending & open_until.between(now_ms + 1, now_ms + 3_600_000)).alias("open"), F.coalesce(F.sum(F.when(F.col("settled_ms").between(day, now_ms), F.col("net"))), F.lit(0.0)).alias("today"))
    last = sent.groupBy("symbol").agg(F.max(F.struct("sent_ms", "direction", "score")).alias("last"))
    r = candidates.crossJoin(F.broadcast(totals)).join(last, "symbol", "left")  # one row of totals
    soon = (F.col("direction") == F.col("last.direction")) & (F.lit(now_ms) - F.col("last.sent_ms") < cooldown_ms) & (F.col("last.score").isNull() | (F.col("score") < F.col("last.score") + better))
    blocked = F.when(F.lit(kill), "kill_switch").when(F.col("open") >= most_open, "max_open").when(F.lit(loss_limit > 0) & (F.col("today") <= -loss_limit), "daily_loss").when(soon, "cooldown")
    return r.select(*candidates.columns, blocked.alias("blocked"))


def cohort_lookup(signals: DataFrame, table: DataFrame) -> DataFrame:
    """The least rate and the least count over the cohorts of a signal's families (null-safe on the other keys)."""
    keys = ("horizon", "direction", "regime", "strategy", "policy", "symbol")
    one = signals.withColumn("family", F.explode("families"))
    c = table.where("audience = 'all'").select("family", *keys, "hit_rate", "resolved")
    j = one.join(c, (one.family == c.family) & _all(one[k].eqNullSafe(c[k]) for k in keys), "left")
    return j.groupBy(one.id).agg(F.min("hit_rate").alias("least_rate"), F.min("resolved").alias("least_resolved"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def arm_metrics(candidates: DataFrame, outcomes: DataFrame, now_ms: int) -> DataFrame:
    """Candidates (arm, id, due) against outcomes (id, won, net): mature, resolved, missing, and a rate where nothing is missing."""
    j = candidates.join(outcomes, "id", "left").where(F.col("due") <= now_ms)
    g = j.groupBy("arm").agg(F.count("*").alias("mature"), F.count("won").alias("resolved"), F.count_if("won").alias("wins"), F.avg("net").alias("m"))
    whole = (F.col("mature") == F.col("resolved")) & (F.col("mature") > 0)
    return g.select("arm", "mature", "resolved", (F.col("mature") - F.col("resolved")).alias("missing"), F.when(whole, F.col("wins") / F.col("mature")).alias("rate"), F.when(whole, F.col("m")).alias("mean_net"))


def verdicts(records: DataFrame, *keys: str, started_ms: int, now_ms: int, decide: int = 28, stop: int = 56, least: int = 100, least_days: int = 15, break_even: float = 0.55, extra_cost: float = 18.0) -> DataFrame:
    """A forward experiment's summary (win rate over wins and losses, net over all settled) and its verdict by ordered rules."""
    done = F.col("status").isNotNull()
    g = records.groupBy(*keys).agg(F.count("*").alias("signals"), F.count_if(done).alias("settled"), F.count_if(F.col("status") == "TARGET").alias("wins"), F.count_if(F.col("status").isin("TARGET", "STOP")).alias("decided"),
                                   F.count_distinct(F.when(done, F.floor(F.col("bar_ms") / DAY))).alias("days"), F.avg(F.when(done, F.col("net"))).alias("mean_net"))
    g = g.withColumns({"win_rate": ratio(F.col("wins").cast("double"), F.col("decided").cast("double")), "stress_net": F.col("mean_net") - extra_cost})
    elapsed = (now_ms - started_ms) / DAY
    verdict = (F.when(F.lit(elapsed < decide), "RUNNING").when((F.col("settled") < least) | (F.col("days") < least_days), F.when(F.lit(elapsed >= stop), "CLOSE").otherwise("TOO_FEW"))
               .when((F.col("mean_net") <= 0) | F.col("win_rate").isNull() | (F.col("win_rate") < break_even), "FAILED").when(F.col("stress_net") > 0, "PASSED").otherwise("UNDECIDED"))
    return g.withColumn("verdict", verdict)


def pivot_levels(ledger: DataFrame, levels: tuple[int, ...] = (2, 3, 5), zone: str = "Europe/Istanbul") -> DataFrame:
    """The dashboard's table: strategy, regime and setup (direction and sorted families) by level: hits, misses and pending, signals and local days."""
    r = ledger.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumns({
        "setup": F.concat_ws(":", "direction", F.array_join(F.array_sort("families"), "+")), "day": F.to_date(F.from_utc_timestamp(F.timestamp_millis("bar_ms"), zone)), "hit": F.when(F.col("status").isNotNull(), F.col("gross") >= F.col("level") * 50)})
    g = r.groupBy("strategy", "regime", "setup").pivot("level", list(levels)).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count_if(F.col("hit").isNull()).alias("pending"))
    n = r.groupBy("strategy", "regime", "setup").agg(F.count_distinct("id").alias("signals"), F.count_distinct("day").alias("days"))
    return g.join(n, ["strategy", "regime", "setup"])


def target_pivot(targets: DataFrame, now_ms: int, audience: str = "all", days: int | None = None, since: str | None = None, until: str | None = None, levels: tuple[int, ...] = (2, 3, 5), zone: str = "Europe/Istanbul") -> DataFrame:
    """Target records (id, strategy, regime, direction, families, notified, source_ms, level, status, success) as one row for each strategy, regime and
    setup: by level hits, misses, pending, missing, hit rate and its Wilson bounds; and distinct signals.

    The window is all records, the last ``days`` (up to five minutes ahead of now), or local dates from ``since`` to ``until``, either open.
    Other levels do not count; DATA_MISSING is missing whatever ``success`` says; a level without records is zeros and null rates.
    """
    r = targets.where(F.col("level").isin(list(levels)))
    if audience != "all":
        r = r.where(F.coalesce("notified", F.lit(False)) == (audience == "notified"))
    local = F.to_date(F.from_utc_timestamp(F.timestamp_millis("source_ms"), zone))
    if since or until:
        r = r.where((local >= F.lit(since).cast("date") if since else local.isNotNull()) & (local <= F.lit(until).cast("date") if until else F.lit(True)))
    elif days is not None:
        r = r.where(F.col("source_ms").between(now_ms - days * DAY, now_ms + 300_000))
    setup = F.concat_ws(" ", F.coalesce("direction", F.lit("UNKNOWN")), F.when(F.size(F.array_compact("families")) > 0, F.array_join(F.array_sort(F.array_distinct(F.array_compact("families"))), "+")).otherwise("UNKNOWN"))
    keys = ["strategy", "regime", "setup"]
    r = r.select(F.coalesce("strategy", F.lit("UNKNOWN")).alias("strategy"), F.coalesce("regime", F.lit("UNKNOWN")).alias("regime"), setup.alias("setup"), "level", "id", "success", F.coalesce(F.col("status") == "DATA_MISSING", F.lit(False)).alias("gone"))
    known = ~F.col("gone")
    aggregates = []
    for k in levels:
        at = F.col("level") == k
        hits, misses = F.count_if(at & known & F.col("success")), F.count_if(at & known & ~F.col("success"))
        low, high = wilson(hits, hits + misses)
        aggregates += [hits.alias(f"hits_{k}"), misses.alias(f"misses_{k}"), F.count_if(at & known & F.col("success").isNull()).alias(f"pending_{k}"), F.count_if(at & F.col("gone")).alias(f"missing_{k}"),
                       (hits / F.nullif(hits + misses, F.lit(0))).alias(f"rate_{k}"), low.alias(f"low_{k}"), high.alias(f"high_{k}")]
    return r.groupBy(*keys).agg(*aggregates, F.count_distinct("id").alias("signals"))


def universe(contracts: DataFrame, snapshots: DataFrame, now_ms: int, least_volume: float, most_funding: float, most_spread: float, cap: int = 0, least_days: int = 14, new_days: int = 365) -> DataFrame:
    """(symbol, place): markets of at least ``least_days`` with enough volume, small funding and a spread from 0 to ``most_spread``. Without a cap all, most liquid
    first; with one a quarter of it for the newest (younger first, then volume), then the most liquid of the rest, ``cap`` in all."""
    age = (F.lit(now_ms) - F.col("onboard_ms")) / DAY
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    r = contracts.join(snapshots, "symbol").withColumn("age", age).where((F.col("age") >= least_days) & finite("quote_volume") & finite("funding_bps") & finite("spread_bps"))
    r = r.where((F.col("quote_volume") >= least_volume) & (F.abs("funding_bps") <= most_funding) & F.col("spread_bps").between(0, most_spread))
    all_ = Window.partitionBy()  # one row for each market
    r = r.withColumn("_new", F.when(F.col("age") <= new_days, F.row_number().over(all_.orderBy(F.col("age") > new_days, "age", F.desc("quote_volume"), "symbol"))))
    first = F.coalesce(F.col("_new") <= cap // 4, F.lit(False))
    place = F.row_number().over(all_.orderBy(~first, F.when(first, F.col("_new")), F.desc("quote_volume"), "symbol"))
    out = r.select("symbol", place.alias("place"))
    return out.where(F.col("place") <= cap) if cap else out


def owner_alerts(records: DataFrame, receipts: DataFrame, runs: DataFrame, least_score: float, fresh_ms: int = 900_000, scan_ms: int = 3_600_000, spacing_ms: int = DAY, stages: tuple[str, ...] = ("CONFIRMED",), strategies: tuple[str, ...] = ("LB1", "LP1")) -> DataFrame:
    """(now_ms, id): what each run (now_ms, started_ms, scanned_ms, regime, healthy) may send to the owner.

    A record (id, symbol, strategy, stage, score, recorded_ms, source_ms) must have come since the run's process started, be fresh by both its times, be of a stage and
    strategy that alert, score enough, meet a healthy confirmed bull regime scanned within the hour, have no receipt (id, symbol, delivered_ms) by then, and its symbol none
    within ``spacing_ms``. Of a symbol's records the earliest, then best one goes. Runs meet records by slots of the fresh time, not each with all.
    """
    good = runs.where((F.col("regime") == "BULL_CONFIRMED") & F.col("healthy") & (F.col("now_ms") - F.col("scanned_ms")).between(0, scan_ms - 1))
    slot = F.floor(F.col("now_ms") / fresh_ms)
    asked = good.withColumn("_slot", F.explode(F.array(slot, slot - 1)))
    may = records.where(F.col("stage").isin(list(stages)) & F.col("strategy").isin(list(strategies)) & (F.col("score") >= least_score)).withColumn("_slot", F.floor(F.col("recorded_ms") / fresh_ms))
    age = lambda c: (F.col("now_ms") - F.col(c)).between(0, fresh_ms)
    r = asked.join(may, "_slot").where((F.col("recorded_ms") >= F.col("started_ms")) & age("recorded_ms") & age("source_ms")).select("now_ms", "id", "symbol", "score", "recorded_ms")
    sent = receipts.select(F.col("id").alias("_id"), F.col("symbol").alias("_s"), "delivered_ms")
    told = r.join(sent, (F.col("symbol") == F.col("_s")) & (F.col("delivered_ms") <= F.col("now_ms")) & ((F.col("id") == F.col("_id")) | (F.col("now_ms") - F.col("delivered_ms") < spacing_ms)), "left_anti")
    first = F.row_number().over(Window.partitionBy("now_ms", "symbol").orderBy("recorded_ms", F.desc("score"), "id"))
    return told.withColumn("_n", first).where("_n = 1").select("now_ms", "id")


def long_records(rows: DataFrame, spacing_ms: int = DAY, hold_ms: int = 7 * DAY, per_scan: int = 5, active: int = 20, bound: int = folds.BOUND) -> DataFrame:
    """(profile, id) of the watch-list rows (profile, id, t, symbol, strategy, confirmed, score) that are recorded: of each scan the ``per_scan`` best (confirmed first, then
    score), not within ``spacing_ms`` of the last record of the symbol and strategy, while fewer than ``active`` records are held for ``hold_ms``."""
    best = Window.partitionBy("profile", "t").orderBy(F.desc("confirmed"), F.desc("score"), "symbol", "id")
    r = rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= per_scan).withColumn("key", F.concat_ws("|", "symbol", "strategy"))

    def fold(state, some):
        last, ends = (dict(zip(state[0], state[1])), list(state[2])) if state else ({}, [])
        out, now = [], 0
        for i, key, t in some:
            now = t
            ends = [e for e in ends if e > t]
            if len(ends) < active and t - last.get(key, -(1 << 60)) >= spacing_ms:
                last[key] = t
                ends.append(t + hold_ms)
                out.append((i,))
        held = sorted((k, int(t)) for k, t in last.items() if now - t < spacing_ms)
        ends = sorted(int(e) for e in ends if e > now)
        return ([k for k, _ in held], [t for _, t in held], ends) if held or ends else None, out

    cut = folds.chunked(r, ("profile",), F.floor(F.col("t") / DAY).cast("long"), bound)
    return folds.folded(cut, ("profile",), [F.col("t"), F.col("place")], ["id", "key", "t"], "keys array<string>, last array<bigint>, ends array<bigint>", f"id {rows.schema['id'].dataType.simpleString()}", fold)


def top_symbols(observations: DataFrame, k: int) -> DataFrame:
    """All observations of the k best symbols: setups first, eligible first, then score, symbol and family."""
    place = F.struct((F.col("tier") != "SETUP").alias("a"), (~F.col("eligible")).alias("b"), (-F.col("score")).alias("c"), "symbol", "family", "id")
    best = observations.groupBy("symbol").agg(F.min(place).alias("p")).orderBy("p").limit(k)
    return observations.join(F.broadcast(best.select("symbol")), "symbol", "left_semi")  # k rows


def best_of_each(observations: DataFrame, k: int) -> DataFrame:
    """One row for each symbol, its best by score among clear directions; the first k."""
    w = Window.partitionBy("symbol").orderBy(F.desc("score"), "id")
    r = observations.where("clear").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return r.orderBy(F.desc("score"), "symbol").limit(k)


def top_contributions(weights: DataFrame, names: tuple[str, ...], k: int = 4) -> DataFrame:
    """The k parts of largest absolute value of each row, with their shares."""
    parts = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in names])
    order = lambda a, b: F.when(F.abs(a.value) > F.abs(b.value), -1).when(F.abs(a.value) < F.abs(b.value), 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
    return weights.select(
        "id", F.posexplode(F.slice(F.array_sort(parts, order), 1, k)).alias("place", "x")).select("id", "place", "x.name", "x.value")


def best_variant(trained: DataFrame, variants: DataFrame, *fold: str) -> DataFrame:
    """Each fold's variant of the best training mean among the eligible (ties: the least name); null where none is."""
    w = Window.partitionBy(*fold).orderBy(F.desc("mean_net"), "variant")
    best = trained.where("eligible").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return variants.join(best.select(*fold, "variant", "mean_net"), list(fold), "left")


def ranked_union(sources: list[DataFrame], key: tuple[str, ...]) -> DataFrame:
    """One table from ledgers of different columns, settled rows before pending ones, later sources before earlier ones."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("_i", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.col("success").isNotNull().desc(), F.desc("_i"))
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_i")


def latest_of(rows: DataFrame, key: tuple[str, ...], *order: Column) -> DataFrame:
    """The newest row of each composite key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def first_valid(sources: list[DataFrame], key: tuple[str, ...], valid: Column) -> DataFrame:
    """Alternative sources in order of priority: each key's first valid row."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_no", F.lit(i))
        out = s if out is None else out.unionByName(s)
    w = Window.partitionBy(*key).orderBy("source_no")
    return out.where(valid).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
