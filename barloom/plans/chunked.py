"""The chain over series of any length: every layer in chunks of cfg.chunk_bars bars, with equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.chunks import KEYS, before, latest, within
from barloom.functions.core import ffill_prev, lag, settled, windows_by
from barloom.operators import displacement, liquidity, outcomes, ranges, structure
from barloom.plans.config import Config

SIDES = ("high", "low")


def structure_facts(bars: DataFrame, cfg: Config) -> DataFrame:
    """Swings by overlaps; then the last two swings of each side, and the newest level crossed, carried into each chunk."""
    swung = settled(within(bars, cfg.chunk_bars, cfg.fractal_length - 1, 0, lambda b: structure.add_swings(b, cfg).withColumn("prev_close", lag("close"))))
    with windows_by(*KEYS):
        seen = swung.withColumns({f"prior_{s}": ffill_prev(F.col(f"swing_{s}")) for s in SIDES})
    ends = seen.groupBy(*KEYS).agg(*[F.max_by(F.struct(F.col(f"swing_{s}").alias("swing"), F.col(f"prior_{s}").alias("before")), F.when(F.col(f"swing_{s}").isNotNull(), F.col("bar_index"))).alias(f"end_{s}") for s in SIDES])
    one = ends.join(before(ends, {f"carry_{s}": latest(f"end_{s}.swing") for s in SIDES}), list(KEYS))
    # the swing before a chunk's last one lies in it or is the one carried into it
    pairs = {f"pair_{s}": F.when(F.col(f"end_{s}").isNotNull(), F.struct(F.col(f"end_{s}.swing.price").alias("now"), F.coalesce(f"end_{s}.before.price", f"carry_{s}.price").alias("before"))) for s in SIDES}
    one = one.withColumns(pairs)
    carry = before(one, {f"carry_pair_{s}": latest(f"pair_{s}") for s in SIDES}).join(one.select(*KEYS, *[f"carry_{s}" for s in SIDES]), list(KEYS))
    high, low = F.col("carry_pair_high"), F.col("carry_pair_low")
    carry = carry.withColumn("carry_ready", structure.ready_of(high, low)).withColumn("carry_trend", F.when(F.col("carry_ready"), structure.trend_of(high, low)).otherwise("ranging"))
    with windows_by(*KEYS):
        trended = settled(structure.add_trend(swung.join(carry, list(KEYS))))
    crossed = trended.groupBy(*KEYS).agg(*[F.max(F.when(structure.crosses(s), F.col(f"prior_{s}.confirm"))).alias(f"crossed_{s}") for s in SIDES])
    used = before(crossed, {f"carry_crossed_{s}": F.max(f"crossed_{s}") for s in SIDES})
    with windows_by(*KEYS):
        out = structure.add_breaks(trended.join(used, list(KEYS)))
    return out.drop("chunk", *[c for c in out.columns if c.startswith("carry_")])


def bar_facts(bars: DataFrame, cfg: Config) -> DataFrame:
    # true range looks one bar back, blocks at candidates before a displacement, and one bar further with a gap
    reach = cfg.atr_period + max(cfg.candidate_lookback, 2) + 3
    return within(structure_facts(bars, cfg), cfg.chunk_bars, reach, 0, lambda f: f.transform(displacement.displacement, cfg).transform(ranges.ranges, cfg)).drop("chunk")


def sweep_context(facts: DataFrame, life: DataFrame, cfg: Config) -> DataFrame:
    return within(facts, cfg.chunk_bars, cfg.sweep_lookback, 0, lambda f: liquidity.add_sweep_context(f, life, cfg)).drop("chunk")


def outcome_facts(facts: DataFrame, cfg: Config) -> DataFrame:
    """Outcomes and regimes."""
    return within(facts, cfg.chunk_bars, 4 * cfg.regime_period, cfg.horizon, lambda f: f.transform(outcomes.add_outcomes, cfg).transform(outcomes.add_regime, cfg)).drop("chunk")
