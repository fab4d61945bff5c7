"""The engine's queries over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.core import settled, shared_folder
from barloom.operators import context, liquidity, outcomes, ranges, structure
from barloom.operators import displacement as blocks
from barloom.plans import chunked
from barloom.plans import facts as P
from barloom.plans import reports as R
from barloom.plans.config import Config, varied
from barloom.sources import candles, quality
from barloom.streaming import chain

#: Low enough that signals are common: without higher timeframes of weeks few bars reach the default.
CFG = Config(score_threshold=30)
LISTED = ("click", "view", "purchase")
#: Years of daily bars by maker, with minima that some windows, months and cells reach and others don't.
DAILY = Config(score_threshold=20, higher=("3d", "1w"), minimum_finalized=3, minimum_windows=2, cell_minimum=4, compare_minimum=4)
MAKERS = ("Maker1", "Maker2", "Maker3")
#: A fixed time to judge freshness at.
NOW = "2024-02-01 00:00:00"


def d(name: str, to: str | None = None) -> Column:
    return F.round(F.col(name).cast("double"), 6).alias(to or name.split(".")[-1])


def known(name: str) -> Column:
    """A bar index, -1 where there is none."""
    return F.coalesce(F.col(name), F.lit(-1)).cast("long").alias(name)


def secs(c: str = "opened_at") -> Column:
    return F.unix_seconds(F.col(c)).alias(c)


def bars(timeframe: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return P.event_bars(spark, sf, timeframe).select("symbol", "bar_index", secs(), d("open"), d("high"), d("low"), d("close"), d("volume"))

    return run


def bars_orders(spark: SparkSession, sf: str) -> DataFrame:
    return P.order_bars(spark, sf, "1d").select("symbol", "bar_index", secs(), d("open"), d("high"), d("low"), d("close"), d("volume"))


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as text candles of one minute, so that the checks meet equal, conflicting and unsound rows."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    value = F.col("value").cast("string")
    stamp = (F.unix_seconds(F.date_trunc("hour", F.col("ts").cast("timestamp"))) * 1000).cast("string")
    raw = e.select(F.col("event_type").alias("series_key"), stamp.alias("timestamp"), *[value.alias(c) for c in ("open", "high", "low", "close")], F.lit("1").alias("volume"))
    return candles.parsed(raw)


def candle_audit(spark: SparkSession, sf: str) -> DataFrame:
    return candles.audit(raw_rows(spark, sf), history_limit=100).select("series_key", "input_rows", "missing_dropped", "rejected", F.col("output_rows").cast("long").alias("output_rows"), "duplicates_removed", F.col("trimmed").cast("long").alias("trimmed"))


def candle_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = candles.cleaned(raw_rows(spark, sf), policy="quarantine")
    return good.select("series_key", secs(), F.lit("kept").alias("state")).unionByName(bad.select("series_key", secs(), F.col("reject_reason").alias("state")))


def latest_n_bars(spark: SparkSession, sf: str) -> DataFrame:
    return candles.latest(P.event_bars(spark, sf, "15m"), 5).select("symbol", "bar_index", d("close"))


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    return quality.internal_gaps(P.event_bars(spark, sf, "15m"), 900).select("series_key", secs("expected_at"), secs("actual_at"), "missing")


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.intervals(P.event_bars(spark, sf, "15m"), 900).withColumn("condition", F.coalesce("condition", F.lit("none")))
    return out.groupBy("symbol", "condition").agg(F.count("*").alias("n"), F.sum("intervals").cast("long").alias("intervals"))


def freshness(spark: SparkSession, sf: str) -> DataFrame:
    return quality.freshness(P.event_bars(spark, sf, "1h"), F.lit(NOW).cast("timestamp"), 3600).select("series_key", d("age_seconds"), "state")


def condition_rollup(spark: SparkSession, sf: str) -> DataFrame:
    b = P.event_bars(spark, sf, "15m")
    events = quality.conditions(candles.audit(raw_rows(spark, sf), 100), quality.internal_gaps(b, 900), quality.freshness(b, F.lit(NOW).cast("timestamp"), 900))
    return events.groupBy("code", "severity").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("distinct_events"))


def structured(spark: SparkSession, sf: str) -> DataFrame:
    return P.structure_facts(P.event_bars(spark, sf, "15m"), CFG)


def swings(spark: SparkSession, sf: str) -> DataFrame:
    return liquidity.touches(structured(spark, sf)).select("symbol", "side", d("price"), "confirm")


def trend(spark: SparkSession, sf: str) -> DataFrame:
    return structured(spark, sf).select("symbol", "bar_index", "trend", "ready")


def structure_events(spark: SparkSession, sf: str) -> DataFrame:
    out = structure.events(structured(spark, sf)).withColumn("month", F.date_format("opened_at", "yyyy-MM"))
    return out.groupBy("symbol", "month", "event", "direction").agg(F.count("*").alias("n"))


def structure_rows(spark: SparkSession, sf: str) -> DataFrame:
    return structure.events(structured(spark, sf)).select("symbol", "bar_index", "direction", "event", d("level"))


def bar_facts(spark: SparkSession, sf: str) -> DataFrame:
    return P.bar_facts(P.event_bars(spark, sf, "15m"), CFG)


def pools(spark: SparkSession, sf: str) -> DataFrame:
    return liquidity.pools(structured(spark, sf), CFG).select("symbol", "side", d("price"), "created_index", "touched_index", "members", "kind", known("breach_index"), "status", F.coalesce("reason", F.lit("-")).alias("reason"))


def sweeps(spark: SparkSession, sf: str) -> DataFrame:
    return liquidity.pools(structured(spark, sf), CFG).where("status = 'swept'").select("symbol", "side", "breach_index", d("price"), d("extreme"))


def active_pools(spark: SparkSession, sf: str) -> DataFrame:
    """Pools that are active after each series' own last bar."""
    return liquidity.pools(structured(spark, sf), CFG).where("status = 'active'").groupBy("symbol", "side").agg(F.count("*").alias("n"), F.round(F.max(F.col("price").cast("double")), 6).alias("top"))


def banded_pools(spark: SparkSession, sf: str) -> DataFrame:
    return liquidity.pools(structured(spark, sf), Config(pool_tolerance_bps=50)).select("symbol", "side", d("lower"), d("upper"), "created_index", "touched_index", "members", "kind", known("breach_index"), "status")


def pool_log(spark: SparkSession, sf: str) -> DataFrame:
    return liquidity.pool_log(structured(spark, sf), CFG).select("symbol", "side", d("price"), "created_index", "bar_index", "status")


def sweep_context(spark: SparkSession, sf: str) -> DataFrame:
    f = structured(spark, sf)
    return liquidity.add_sweep_context(f, liquidity.pools(f, CFG), CFG).select("symbol", "bar_index", "sweep_context")


def atr(spark: SparkSession, sf: str) -> DataFrame:
    return bar_facts(spark, sf).select("symbol", "bar_index", d("tr"), F.round(F.col("prior_tr").cast("double") / 14, 6).alias("prior_atr"), F.round(F.col("now_tr").cast("double") / 14, 6).alias("atr"))


def candle_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.candle_metrics(bar_facts(spark, sf), CFG).select("symbol", "bar_index", F.coalesce("candle", F.lit("doji")).alias("candle"), d("close_location"), d("body_atr"), d("span_atr"))


def displacement(spark: SparkSession, sf: str) -> DataFrame:
    return bar_facts(spark, sf).where("displacement IS NOT NULL").select("symbol", "bar_index", "displacement", d("body"), d("span"))


def fvg(spark: SparkSession, sf: str) -> DataFrame:
    return bar_facts(spark, sf).where("gap IS NOT NULL").select("symbol", "bar_index", "gap", d("gap_low"), d("gap_high"), "gap_displaced")


def order_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return bar_facts(spark, sf).where("block IS NOT NULL").select("symbol", "bar_index", "block", d("block_low"), d("block_high"), "block_index")


def dealing_range(spark: SparkSession, sf: str) -> DataFrame:
    return bar_facts(spark, sf).select("symbol", "bar_index", "range_status", d("range_low"), d("range_high"), F.coalesce("range_direction", F.lit("-")).alias("range_direction"), known("range_confirm"))


def pd_class(spark: SparkSession, sf: str) -> DataFrame:
    return bar_facts(spark, sf).groupBy("symbol", "pd_class").agg(F.count("*").alias("n"), F.sum("bar_index").alias("indexes"))


def pd_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays published on each bar by where their ends and representative price lie in its range."""
    f = bar_facts(spark, sf)
    out = ranges.annotated(f, liquidity.pools(f, CFG), liquidity.pool_log(f, CFG), CFG)
    return out.select("symbol", "bar_index", "kind", d("low"), d("high"), d("price"), "low_class", "high_class", "price_class")


def retracement(spark: SparkSession, sf: str) -> DataFrame:
    return bar_facts(spark, sf).select("symbol", "bar_index", d("ote_low"), d("ote_high"), "ote_position")


def structure_shift(spark: SparkSession, sf: str) -> DataFrame:
    return bar_facts(spark, sf).where("shift IS NOT NULL").select("symbol", "bar_index", "shift", d("shift_level"))


def shift_context(spark: SparkSession, sf: str) -> DataFrame:
    f = settled(bar_facts(spark, sf))
    life = liquidity.pools(f, CFG)
    out = ranges.shift_context(liquidity.add_sweep_context(f, life, CFG), life, liquidity.pool_log(f, CFG, life), CFG)
    return out.select("symbol", "bar_index", "shift", "relation", "detail", d("low"), d("high"), "ref_index", F.coalesce("price_class", F.lit("-")).alias("price_class"))


def breakers(spark: SparkSession, sf: str) -> DataFrame:
    return liquidity.breakers(bar_facts(spark, sf)).select("symbol", "published_index", "direction", "hit_index", F.coalesce("rejection", F.lit("-")).alias("rejection"), F.coalesce("breaker", F.lit("-")).alias("breaker"))


def mitigations(spark: SparkSession, sf: str) -> DataFrame:
    return liquidity.mitigations(bar_facts(spark, sf)).select("symbol", "published_index", "direction", "hit_index", d("overlap_low"), d("overlap_high"), d("overlap_size"))


def registry(spark: SparkSession, listed: tuple[str, ...] = LISTED) -> DataFrame:
    return spark.createDataFrame([(s,) for s in listed], "symbol string")


Source = tuple[DataFrame, dict[str, DataFrame], DataFrame]


def source(spark: SparkSession, sf: str, cfg: Config) -> Source:
    """(bars, higher bars, registry): those of events, or of order lines for settings with their timeframes. Their table is read once."""
    read, timeframe, listed = (P.line_bars, "1d", MAKERS) if cfg.higher == DAILY.higher else (P.event_bars, "15m", LISTED)
    return *P.with_higher(read(spark, sf, timeframe), cfg.higher), registry(spark, listed)


def full(spark: SparkSession, sf: str, cfg: Config = CFG, given: Source | None = None) -> DataFrame:
    bars, higher, listed = given or source(spark, sf, cfg)
    return P.signal_facts(bars, higher, listed, cfg)


#: Series of 1,441 bars and more in chunks of this many, to hold the chunked chain against the same SQL.
CHUNKED = Config(score_threshold=30, chunk_bars=200)


def chunked_structure(spark: SparkSession, sf: str) -> DataFrame:
    facts = P.structure_facts(P.event_bars(spark, sf, "15m", CHUNKED.chunk_bars), CHUNKED)
    return structure.events(facts).select("symbol", "bar_index", "direction", "event", d("level"))


def chunked_blocks(spark: SparkSession, sf: str) -> DataFrame:
    facts = P.bar_facts(P.event_bars(spark, sf, "15m", CHUNKED.chunk_bars), CHUNKED)
    return facts.where("block IS NOT NULL").select("symbol", "bar_index", "block", d("block_low"), d("block_high"), "block_index")


def chunked_signals(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain in chunks, from the numbering of bars to the as-of joins with higher timeframes."""
    bars, higher = P.with_higher(P.event_bars(spark, sf, "15m", CHUNKED.chunk_bars), CHUNKED.higher, CHUNKED.chunk_bars)
    out = P.signal_facts(bars, higher, registry(spark), CHUNKED)
    return out.select("symbol", "bar_index", "signal", F.array_join("reasons", ",").alias("reasons"))


def streamed_signals(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain as a stream sees it: three batches, each with what the one before it carries."""
    own, higher = P.with_higher(P.event_bars(spark, sf, "15m"), CFG.higher)
    bars = reduce(DataFrame.unionByName, [own, *higher.values()])
    folder = shared_folder(spark, "chain")
    chain.replay(bars, 3, folder, "15m", registry, CFG)
    return chain.results(spark, folder, "facts").select("symbol", "bar_index", "signal", F.array_join("reasons", ",").alias("reasons"))


def chunked_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    out = chunked.outcome_facts(P.event_bars(spark, sf, "15m", CHUNKED.chunk_bars), CHUNKED)
    return out.select("symbol", "bar_index", "outcome", d("mfe_price"), known("mfe_index"), d("mae_price"), known("mae_index"), d("final_return"))


def mtf_confluence(spark: SparkSession, sf: str) -> DataFrame:
    bars, higher = P.with_higher(P.event_bars(spark, sf, "15m"), CFG.higher)
    return context.add_confluence(bars, {tf: P.structure_facts(b, CFG) for tf, b in higher.items()}).select("symbol", "bar_index", "direction_1h", "direction_4h", known("cursor_1h"), known("cursor_4h"), "confluence")


def htf_evidence(spark: SparkSession, sf: str) -> DataFrame:
    bars, above = P.with_higher(P.event_bars(spark, sf, "1h"), ("4h",))
    higher = settled(P.bar_facts(above["4h"], CFG))
    life = liquidity.pools(higher, CFG)
    evidence = context.published_evidence(higher, life, liquidity.pool_log(higher, CFG, life))
    out = context.htf_evidence(bars, evidence, "4h")
    return out.select("symbol", "bar_index", known("cursor_4h"), *[F.col(f"{k}_4h").alias(k) for k in (*context.PUBLISHED, *context.STATE)])


def registry_status(spark: SparkSession, sf: str) -> DataFrame:
    return context.add_registry(P.event_bars(spark, sf, "4h"), registry(spark), "allow").groupBy("symbol", "status", "status_reason").agg(F.count("*").alias("n"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return full(spark, sf).select("symbol", "bar_index", F.col("score").cast("long").alias("score"), "passed", F.array_join("score_reasons", ",").alias("score_reasons"))


def eligibility(spark: SparkSession, sf: str) -> DataFrame:
    return full(spark, sf).select("symbol", "bar_index", "bias", "eligibility", F.size(F.filter("votes", lambda v: v["bias"].isNotNull())).cast("long").alias("n_votes"), F.array_join("eligibility_reasons", ",").alias("eligibility_reasons"))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return full(spark, sf).select("symbol", "bar_index", "signal", F.array_join("reasons", ",").alias("reasons"))


def published(spark: SparkSession, sf: str, cfg: Config = CFG, given: Source | None = None) -> DataFrame:
    return R.signal_rows(full(spark, sf, cfg, given))


def outcome_rows(spark: SparkSession, sf: str) -> DataFrame:
    out = P.event_bars(spark, sf, "15m").transform(outcomes.add_outcomes, CFG)
    return out.select("symbol", "bar_index", "outcome", d("mfe_price"), known("mfe_index"), d("mae_price"), known("mae_index"), d("final_return"))


def outcome_running(spark: SparkSession, sf: str) -> DataFrame:
    given = source(spark, sf, CFG)
    return outcomes.running(published(spark, sf, CFG, given), given[0], CFG.horizon).withColumn("symbol", F.element_at(F.split("series_key", ":"), 1)).select("symbol", "bar_index", "open", "finalized", "win")


def outcome_log(spark: SparkSession, sf: str) -> DataFrame:
    given = source(spark, sf, CFG)
    log = outcomes.outcome_log(published(spark, sf, CFG, given), given[0], CFG.horizon)
    return outcomes.latest_versions(log).groupBy("version").agg(F.count("*").alias("n"), F.sum("step").cast("long").alias("steps"))


def ema_rsi(spark: SparkSession, sf: str) -> DataFrame:
    out = outcomes.ema_rsi(P.event_bars(spark, sf, "1h"), CFG)
    return out.select(F.element_at(F.split("series_key", ":"), 1).alias("symbol"), "bar_index", d("ema_20"), d("ema_50"), d("rsi"))


def volume_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return P.event_bars(spark, sf, "15m").transform(outcomes.add_volume_ratio, CFG).select("symbol", "bar_index", d("volume_average"), d("volume_ratio"))


def attribution(spark: SparkSession, sf: str) -> DataFrame:
    return published(spark, sf).select("symbol", "bar_index", "combination", F.size("labels").cast("long").alias("n_labels"))


STATS = ("total", "open", "win", "loss", "flat", "finalized")


def stats(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("long").alias(c) for c in STATS], d("win_rate"), F.round("avg_return", 5).alias("avg_return"))


def performance(spark: SparkSession, sf: str) -> DataFrame:
    return stats(R.performance(published(spark, sf), CFG), "dimension", "group", "sufficient")


def performance_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return R.ranked(R.performance(published(spark, sf), CFG), "combination")


def monthly_review(spark: SparkSession, sf: str, cfg: Config = CFG) -> DataFrame:
    out = R.monthly_review(published(spark, sf, cfg), cfg)
    return out.select("month", F.coalesce("previous", F.lit("-")).alias("previous"), "total", "finalized", d("win_rate"), F.round("avg_return", 5).alias("avg_return"), d("win_rate_change"))


def regimes(spark: SparkSession, sf: str) -> DataFrame:
    return P.event_bars(spark, sf, "15m").transform(outcomes.add_regime, CFG).select("symbol", "bar_index", d("efficiency"), d("volatility"), F.coalesce("regime", F.lit("-")).alias("regime"))


def walk_forward_plan(spark: SparkSession, sf: str) -> DataFrame:
    return R.window_plan(P.event_bars(spark, sf, "15m"), CFG).select("series_key", "window_id", "first", "split", "last")


def walked(spark: SparkSession, sf: str, cfg: Config = CFG, given: Source | None = None) -> DataFrame:
    """The BUY signals of each window, by the whole chain over the window's own bars; regimes are those of the whole series."""
    b, higher, listed = given or source(spark, sf, cfg)
    f = P.signal_facts(R.window_bars(b, cfg), higher, listed, cfg).where("signal = 'BUY_SIGNAL'")
    regimes = b.transform(outcomes.add_regime, cfg).select(F.col("series_key").alias("parent_key"), "opened_at", "regime")
    f = f.drop("regime").join(regimes, ["parent_key", "opened_at"], "left")
    return f.withColumn("month", F.date_format("opened_at", "yyyy-MM"))


def walk_segments(spark: SparkSession, sf: str, cfg: Config = CFG) -> DataFrame:
    given = source(spark, sf, cfg)
    plan = R.window_plan(given[0], cfg).withColumn("symbol", F.element_at(F.split("series_key", ":"), 1))
    return R.segments(walked(spark, sf, cfg, given), plan, cfg, "symbol", "window_id")


def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    return stats(walk_segments(spark, sf), "symbol", "window_id", "segment")


def stability(spark: SparkSession, sf: str, cfg: Config = CFG) -> DataFrame:
    out = R.stability(walk_segments(spark, sf, cfg), cfg, "symbol")
    spreads = [F.round(f"{k}_spread", 5).alias(f"{k}_spread") for k in ("win", "return", "mfe", "mae")]
    return out.select("symbol", "windows", "sampled", "positive", "negative", *spreads, known("best"), known("worst"), "status")


def walk_changes(spark: SparkSession, sf: str, cfg: Config = CFG) -> DataFrame:
    return R.degradation(walk_segments(spark, sf, cfg), cfg, "symbol", "window_id")


def degradation(spark: SparkSession, sf: str, cfg: Config = CFG) -> DataFrame:
    return walk_changes(spark, sf, cfg).select("symbol", "window_id", d("win_rate_change"), F.round("avg_return_change", 5).alias("avg_return_change"), "both")


def degradation_summary(spark: SparkSession, sf: str, cfg: Config = CFG) -> DataFrame:
    out = R.degradation_summary(walk_changes(spark, sf, cfg), "symbol")
    return out.select("symbol", "windows", "comparable", F.round("mean_win_rate_change", 5).alias("mean_win_rate_change"), F.round("mean_avg_return_change", 5).alias("mean_avg_return_change"))


def validated(spark: SparkSession, sf: str, cfg: Config = CFG) -> DataFrame:
    return walked(spark, sf, cfg).where(F.col("bar_index") >= cfg.development_bars)


def out_of_sample(spark: SparkSession, sf: str) -> DataFrame:
    dims = {"symbol": "symbol", "timeframe": "timeframe", "combination": "combination", "month": "month", "regime": "regime"}
    return stats(R.buckets(validated(spark, sf), dims, CFG), "dimension", "group", "sufficient")


def cells(spark: SparkSession, sf: str, cfg: Config = CFG) -> DataFrame:
    return stats(R.cells(validated(spark, sf, cfg), cfg), "dimension", "group", "pattern", "diagnosis").drop("avg_return")


def findings(spark: SparkSession, sf: str, cfg: Config = CFG) -> DataFrame:
    return R.findings(R.cells(validated(spark, sf, cfg), cfg)).select("dimension", "group", "finalized", d("win_rate"))


def compare_variants(spark: SparkSession, sf: str, cfg: Config = CFG, higher_threshold: int = 45) -> DataFrame:
    """The signals of the settings against those of a candidate with a higher threshold, each by the whole chain."""
    dims = {"symbol": "symbol", "month": "month", "combination": "combination"}
    candidate = varied(cfg, {"score_threshold": (cfg.score_threshold, higher_threshold)})
    given = source(spark, sf, cfg)  # candidates change no timeframe
    out = R.compare(R.buckets(published(spark, sf, cfg, given), dims, cfg), R.buckets(published(spark, sf, candidate, given), dims, candidate), cfg)
    return out.where("metric = 'win_rate'").select("dimension", "group", "base_sample", "cand_sample", d("base"), d("cand"), d("difference"), "conclusive")


def daily(query: Callable[..., DataFrame], *more: int) -> Callable[[SparkSession, str], DataFrame]:
    """The query over daily bars of order lines."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return query(spark, sf, DAILY, *more)

    return run


def threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    grid = spark.createDataFrame([("low", 30), ("middle", 40), ("high", 50)], "variant string, threshold int")
    return R.threshold_grid(full(spark, sf), grid).groupBy("variant", "symbol").agg(F.count("*").alias("n"))


def chart_primitives(spark: SparkSession, sf: str) -> DataFrame:
    f = settled(full(spark, sf))
    shown = R.chart(f, liquidity.pools(f, CFG), CFG, outcomes.ema_rsi(f, CFG))
    return shown.select("series_key", "kind", "name", "bar_index", known("end_index"), d("low"), d("high"))


def price_domain(spark: SparkSession, sf: str) -> DataFrame:
    f = settled(bar_facts(spark, sf))
    return R.price_domain(f, R.chart(f, liquidity.pools(f, CFG), CFG)).select("series_key", d("low"), d("high"))


def ledger_stats(spark: SparkSession, sf: str) -> DataFrame:
    seen = published(spark, sf)
    rows, _ = R.ledger(seen.unionByName(seen))
    return stats(R.ledger_stats(rows).withColumn("month", F.coalesce("month", F.lit("all"))), "month")


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.functions.core import dataset_fingerprint

    bars = P.event_bars(spark, sf, "15m")
    return dataset_fingerprint(candles.records(bars).withColumn("series_key", F.concat_ws(":", "symbol", "timeframe")), record=F.col("record"))


NAMES = (
    bars_orders, candle_audit, candle_conflicts, latest_n_bars, gaps, intervals, freshness, condition_rollup, swings, trend, structure_events, structure_rows, pools, sweeps, active_pools, banded_pools, pool_log, sweep_context,
    atr, displacement, fvg, order_blocks, dealing_range, pd_class, pd_arrays, retracement, structure_shift, shift_context, breakers, mitigations, mtf_confluence, htf_evidence, registry_status, scores, eligibility, signals, outcome_rows, outcome_running,
    outcome_log, ema_rsi, volume_ratio, attribution, performance, performance_ranks, monthly_review, regimes, walk_forward_plan, walk_forward, stability, degradation, degradation_summary, out_of_sample, cells, findings, compare_variants, threshold_grid,
    chart_primitives, price_domain, ledger_stats, fingerprints, candle_metrics, chunked_structure, chunked_blocks, chunked_signals, chunked_outcomes, streamed_signals,
)
QUERIES = {"bars_15m": bars("15m"), "bars_1h": bars("1h"), **{f.__name__: f for f in NAMES}}
QUERIES |= {f"{f.__name__}_daily": daily(f) for f in (monthly_review, stability, degradation, degradation_summary, cells, findings)} | {"compare_variants_daily": daily(compare_variants, 35)}
