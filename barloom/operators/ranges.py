"""Dealing ranges, premium and discount, structure shifts, and retracement zones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.core import lag
from barloom.operators.displacement import ratio
from barloom.plans.config import Config


def add_range(df: DataFrame) -> DataFrame:
    """range_status, range_low, range_high, range_direction, range_confirm and range_known_at from the latest swings, this bar's included."""
    low, high = F.col("last_low"), F.col("last_high")
    status = F.when(low.isNull() | high.isNull(), "missing_swings").when(low["pivot"] == high["pivot"], "same_pivot").when(high["price"] <= low["price"], "nonpositive_span").otherwise("confirmed")
    out = df.withColumn("range_status", status)
    ok = F.col("range_status") == "confirmed"
    return out.withColumns({
        "range_low": F.when(ok, low["price"]), "range_high": F.when(ok, high["price"]),
        "range_direction": F.when(ok, F.when(low["pivot"] < high["pivot"], "bullish").otherwise("bearish")),
        "range_confirm": F.when(ok, F.greatest(low["confirm"], high["confirm"])),
        "range_known_at": F.when(ok, F.greatest(low["known_at"], high["known_at"])),
    })


def classify(price: Column, cfg: Config) -> Column:
    """Where a price lies in the current range; the equilibrium band includes its ends."""
    span = F.col("range_high") - F.col("range_low")
    middle = F.col("range_low") + span * ratio(0.5)
    half = span * ratio(cfg.equilibrium_half_width)
    out = F.when(F.col("range_low").isNull() | price.isNull(), "INSUFFICIENT_CONTEXT").when((price < F.col("range_low")) | (price > F.col("range_high")), "OUTSIDE_RANGE")
    return out.when((price >= middle - half) & (price <= middle + half), "EQUILIBRIUM").when(price < middle, "DISCOUNT").otherwise("PREMIUM")


def annotated(facts: DataFrame, life: DataFrame, log: DataFrame, cfg: Config) -> DataFrame:
    """Arrays that are published on each bar, with where their bounds and representative price lie in its range.

    (kind, low, high, price): versions of pools by their band and first price, sweeps by their
    extreme, displacements by their close, gaps and order blocks by their bounds and midpoint.
    """

    def array(kind: str, there: Column, low: str, high: str, price: Column) -> Column:
        return F.when(there, F.struct(F.lit(kind).alias("kind"), F.col(low).alias("low"), F.col(high).alias("high"), price.cast("decimal(20,9)").alias("price")))

    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    own = F.array(
        array("displacement", F.col("displacement").isNotNull(), "close", "close", F.col("close")),
        array("fvg", F.col("gap").isNotNull(), "gap_low", "gap_high", middle("gap_low", "gap_high")),
        array("order_block", F.col("block").isNotNull(), "block_low", "block_high", middle("block_low", "block_high")),
    )
    keys, bounds = ["series_key", "symbol", "bar_index"], ["range_low", "range_high"]
    out = facts.select(*keys, *bounds, F.explode(F.filter(own, lambda z: z.isNotNull())).alias("z")).select(*keys, *bounds, "z.*")
    pool = log.select("series_key", "bar_index", F.lit("liquidity_pool").alias("kind"), F.col("lower").alias("low"), F.col("upper").alias("high"), F.col("price").cast("decimal(20,9)").alias("price"))
    swept = life.where("status = 'swept'").select("series_key", F.col("breach_index").alias("bar_index"), F.lit("sweep").alias("kind"), F.col("extreme").alias("low"), F.col("extreme").alias("high"), F.col("extreme").cast("decimal(20,9)").alias("price"))
    out = out.unionByName(facts.select(*keys, *bounds).join(pool.unionByName(swept), ["series_key", "bar_index"]).select(*out.columns))
    classes = {f"{c}_class": classify(F.col(c), cfg) for c in ("low", "high", "price")}
    return out.withColumns(classes).drop(*bounds)


def add_premium_discount(df: DataFrame, cfg: Config) -> DataFrame:
    return df.withColumn("pd_class", classify(F.col("close"), cfg))


def add_retracement(df: DataFrame, cfg: Config) -> DataFrame:
    """ote_low, ote_high and the position of the close; a range confirmed on this bar, or not available when it opened, is no context yet."""
    span = F.col("range_high") - F.col("range_low")
    near, far = (ratio(r) for r in cfg.retracement)
    bull = F.col("range_direction") == "bullish"
    a = F.when(bull, F.col("range_high") - span * near).otherwise(F.col("range_low") + span * near)
    b = F.when(bull, F.col("range_high") - span * far).otherwise(F.col("range_low") + span * far)
    known = (F.col("range_confirm") < F.col("bar_index")) & (F.col("range_known_at") <= F.col("opened_at"))
    out = df.withColumn("ote_low", F.when(span.isNotNull(), F.least(a, b))).withColumn("ote_high", F.when(span.isNotNull(), F.greatest(a, b)))
    place = F.when(~F.coalesce(known, F.lit(False)), "INSUFFICIENT_CONTEXT").when(F.col("close") < F.col("ote_low"), "BELOW_OTE").when(F.col("close") > F.col("ote_high"), "ABOVE_OTE").otherwise("INSIDE_OTE")
    return out.withColumn("ote_position", place)


def add_shift(df: DataFrame) -> DataFrame:
    """shift and shift_level: a CHoCH in the direction of this bar's displacement against the trend before.

    The bar before and the level it breaks were available when this bar opened.
    """
    level = F.when(F.col("displacement") == "bullish", lag("last_high")).otherwise(lag("last_low"))
    event = F.when(F.col("displacement") == "bullish", F.col("event_up")).otherwise(F.col("event_down"))
    out = df.withColumn("level", level)
    turns = F.col("prev_ready") & (F.col("prev_trend") != "ranging") & (F.col("displacement") != F.col("prev_trend")) & (event == "CHoCH") & F.col("level").isNotNull()
    turns = turns & (lag("available_at") <= F.col("opened_at")) & (F.col("level.known_at") <= F.col("opened_at"))
    out = out.withColumn("shift", F.when(turns, F.col("displacement")))
    return out.withColumn("shift_level", F.when(F.col("shift").isNotNull(), F.col("level.price"))).drop("level")


def shift_context(facts: DataFrame, life: DataFrame, log: DataFrame, cfg: Config) -> DataFrame:
    """What each structure shift goes with, one row each: (relation, detail, low, high, ref_index, price_class).

    displacement: its own; pool: the version published on its bar of the pool that holds the broken
    level; swept_pool: pools of the sweeps before it; gap and order_block: those of its direction
    published on its bar. price_class says where the representative price lies in the bar's range;
    pools swept on earlier bars have none. facts come with sweep context.
    """
    bull = F.col("shift") == "bullish"
    level = F.when(bull, F.col("prior_high")).otherwise(F.col("prior_low"))
    side = F.when(bull, "buy_side").otherwise("sell_side")
    keys, bounds = ["series_key", "symbol", "bar_index", "shift"], ["range_low", "range_high"]
    s = facts.where("shift IS NOT NULL").withColumns({"level": level, "side": side})

    def rows(df: DataFrame, relation: str, detail: str, low: str, high: str, ref: str, price: Column | None) -> DataFrame:
        where = F.lit(None).cast("string") if price is None else classify(price, cfg)
        return df.select(*keys, F.lit(relation).alias("relation"), F.col(detail).alias("detail"), F.col(low).alias("low"), F.col(high).alias("high"), F.col(ref).cast("long").alias("ref_index"), where.alias("price_class"))

    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    held = s.select(*keys, *bounds, "side", "level").join(log.select("series_key", "side", "bar_index", "price", "lower", "upper", "created_index", "status"), ["series_key", "side", "bar_index"])
    held = held.where("level.price BETWEEN lower AND upper AND created_index <= level.confirm")  # bands may overlap: a swing joins the oldest
    held = held.groupBy(*keys, *bounds).agg(F.min(F.struct("created_index", "status", "price", "lower", "upper")).alias("p")).select(*keys, *bounds, "p.*")
    swept = life.where("status = 'swept'").select("series_key", F.col("breach_index").alias("sweep_index"), F.col("side").alias("swept_side"), "lower", "upper")
    own = F.col("block") == F.col("shift") if not cfg.require_fvg else F.lit(False)  # else the block follows an earlier displacement
    parts = [
        rows(s, "displacement", "displacement", "close", "close", "bar_index", F.col("close")),
        rows(held, "pool", "status", "lower", "upper", "created_index", F.col("price")),
        rows(s.select(*keys, "sweep_index").join(swept, ["series_key", "sweep_index"]), "swept_pool", "swept_side", "lower", "upper", "sweep_index", None),
        rows(s.where("gap = shift"), "gap", "gap", "gap_low", "gap_high", "bar_index", middle("gap_low", "gap_high")),
        rows(s.where(own), "order_block", "block", "block_low", "block_high", "block_index", middle("block_low", "block_high")),
    ]
    return reduce(DataFrame.unionByName, parts)


def ranges(facts: DataFrame, cfg: Config) -> DataFrame:
    return facts.transform(add_range).transform(add_premium_discount, cfg).transform(add_retracement, cfg).transform(add_shift)
