"""The chain from candles to signals with outcomes, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.core import settled
from barloom.operators import context, displacement, liquidity, outcomes, ranges, signals, structure
from barloom.plans import chunked
from barloom.plans.config import Config
from barloom.sources import candles


def structure_facts(bars: DataFrame, cfg: Config) -> DataFrame:
    return chunked.structure_facts(bars, cfg) if cfg.chunk_bars else structure.structure(bars, cfg)


def bar_facts(bars: DataFrame, cfg: Config) -> DataFrame:
    """Structure, displacement, gaps, order blocks, ranges, shifts and zones of every bar."""
    if cfg.chunk_bars:
        return chunked.bar_facts(bars, cfg)
    return structure_facts(bars, cfg).transform(displacement.displacement, cfg).transform(ranges.ranges, cfg)


def signal_facts(bars: DataFrame, higher: dict[str, DataFrame], registry: DataFrame, cfg: Config) -> DataFrame:
    """bar_facts with sweeps, higher-timeframe context, scores, signals, labels and outcomes; higher: bars by timeframe."""
    facts = settled(bar_facts(bars, cfg))
    life = liquidity.pools(facts, cfg)
    facts = chunked.sweep_context(facts, life, cfg) if cfg.chunk_bars else liquidity.add_sweep_context(facts, life, cfg)
    facts = context.add_confluence(facts, {tf: structure_facts(b, cfg) for tf, b in higher.items()}, cfg.chunk_bars)
    facts = context.add_registry(facts, registry, cfg.registry_mode)
    facts = signals.add_scores(facts, cfg).transform(signals.add_votes).transform(signals.add_signals, cfg).transform(signals.add_labels)
    if cfg.chunk_bars:
        return chunked.outcome_facts(facts, cfg)
    return facts.transform(outcomes.add_outcomes, cfg).transform(outcomes.add_regime, cfg)


def event_bars(spark: SparkSession, sf_dir: str, timeframe: str, chunk_bars: int | None = None) -> DataFrame:
    """Candles of the events table: one symbol per event type, the value as the price; chunk_bars: bars numbered at once."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    bars = candles.bars_from_events(events, timeframe, F.col("event_type"), F.col("ts"), F.col("value"), F.lit(1), [F.col("event_id")])
    return candles.as_series(bars, timeframe, chunk_bars=chunk_bars)


def line_bars(spark: SparkSession, sf_dir: str, timeframe: str, chunk_bars: int | None = None) -> DataFrame:
    """Candles of order lines: one symbol per maker of parts, the price of a unit as the price."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("Maker"), F.substring("p_brand", 7, 1)).alias("maker"))
    price = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 4)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", price.alias("price")).join(parts, "l_partkey")
    bars = candles.bars_from_moments(lines, timeframe, F.col("maker"), F.col("l_shipdate"), F.col("price"), F.lit(1), candles.in_order("l_orderkey", "l_linenumber"))
    return candles.as_series(bars, timeframe, chunk_bars=chunk_bars)


def with_higher(bars: DataFrame, higher: tuple[str, ...], chunk_bars: int | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(bars, bars by higher timeframe): the table of events is read once, however many plans start from its bars."""
    bars = settled(bars)
    return bars, {tf: candles.as_series(candles.rolled(bars, tf), tf, chunk_bars=chunk_bars) for tf in higher}


def order_bars(spark: SparkSession, sf_dir: str, timeframe: str) -> DataFrame:
    """Candles of the orders table: one symbol per priority, the total as the price."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    bars = candles.bars_from_events(orders, timeframe, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), F.lit(1), [F.col("o_orderkey")])
    return candles.as_series(bars, timeframe)
