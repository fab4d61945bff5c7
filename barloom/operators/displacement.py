"""Average true range, displacement, three-bar gaps and order blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.core import lag, rows
from barloom.plans.config import Config


def ratio(value: float):
    """A threshold with four decimals, so that products with prices stay exact."""
    return F.lit(str(value)).cast("decimal(6,4)")


def add_displacement(df: DataFrame, cfg: Config) -> DataFrame:
    """tr, now_tr and prior_tr (sums of the last atr_period true ranges, with this bar's and before it), body, span, candle and displacement.

    All gates are products of decimals; nothing is divided.
    """
    n = cfg.atr_period
    pc = lag("close")
    out = df.withColumn("tr", F.when(pc.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))))
    for name, first, last in (("prior_tr", -n, -1), ("now_tr", 1 - n, 0)):
        out = out.withColumn(name, F.when(F.count("tr").over(rows(first, last)) == n, F.sum("tr").over(rows(first, last)).cast("decimal(28,8)")))
    out = out.withColumns({"body": F.abs(F.col("close") - F.col("open")), "span": F.col("high") - F.col("low"), "candle": F.when(F.col("close") > F.col("open"), "bullish").when(F.col("close") < F.col("open"), "bearish")})
    count = F.lit(n).cast("decimal(4,0)")
    strong = (F.col("prior_tr") > ratio(cfg.atr_floor) * count) & (F.col("body") * count >= ratio(cfg.min_body_atr) * F.col("prior_tr")) & (F.col("span") * count >= ratio(cfg.min_range_atr) * F.col("prior_tr"))
    place = F.col("close") - F.col("low")
    near_end = F.when(F.col("candle") == "bullish", place >= ratio(cfg.close_location) * F.col("span")).otherwise(place <= ratio(round(1 - cfg.close_location, 4)) * F.col("span"))
    return out.withColumn("displacement", F.when(F.col("candle").isNotNull() & (F.col("span") > 0) & strong & near_end, F.col("candle")))


def candle_metrics(df: DataFrame, cfg: Config) -> DataFrame:
    """Where each bar closes in its span (0 at the low, 1 at the high), and its body and span in average true ranges; null where either is 0."""
    atr = F.nullif(F.col("prior_tr").cast("double") / cfg.atr_period, F.lit(0.0))
    place = F.try_divide((F.col("close") - F.col("low")).cast("double"), F.col("span").cast("double"))
    return df.withColumns({"close_location": place, "body_atr": F.col("body").cast("double") / atr, "span_atr": F.col("span").cast("double") / atr})


def add_gaps(df: DataFrame, cfg: Config) -> DataFrame:
    """gap, gap_low, gap_high, gap_displaced on the third bar of a gap."""
    high1, low1 = lag("high", 2), lag("low", 2)
    out = df.withColumns({"h1": high1, "l1": low1, "middle": lag("displacement", 1)})
    up, down = F.col("low") > F.col("h1"), F.col("high") < F.col("l1")
    size = F.when(up, F.col("low") - F.col("h1")).when(down, F.col("l1") - F.col("high"))
    kind = F.when(up, "bullish").when(down, "bearish")
    ok = size >= F.lit(str(cfg.min_gap_size)).cast("decimal(18,8)")
    if cfg.require_displacement:
        ok = ok & (F.col("middle") == kind)
    out = out.withColumn("gap", F.when(ok, kind))
    out = out.withColumn("gap_low", F.when(F.col("gap") == "bullish", F.col("h1")).when(F.col("gap") == "bearish", F.col("high")))
    out = out.withColumn("gap_high", F.when(F.col("gap") == "bullish", F.col("low")).when(F.col("gap") == "bearish", F.col("l1")))
    return out.withColumn("gap_displaced", F.coalesce(F.col("middle") == F.col("gap"), F.lit(False))).drop("h1", "l1", "middle")


def add_blocks(df: DataFrame, cfg: Config) -> DataFrame:
    """block (direction), block_low, block_high, block_index on the bar that publishes an order block.

    The candidate is the nearest (or earliest) bar of the other colour among the bars before a
    displacement that was available when that opened, bars that close where they open too with
    allow_doji; it counts only if the close is beyond it and the wanted break is on this bar.
    """
    low, high = ("low", "high") if cfg.block_zone == "range" else ("zl", "zh")
    out = df.withColumn("zl", F.least("open", "close")).withColumn("zh", F.greatest("open", "close"))
    zone = F.struct(F.col("bar_index").alias("i"), F.col(low).alias("lo"), F.col(high).alias("hi"), F.col("available_at").alias("known_at"), F.col("candle").alias("colour"))
    earlier = F.collect_list(F.when(F.col(high) > F.col(low), zone)).over(rows(-cfg.candidate_lookback, -1))  # candidate_lookback at most

    def fits(z: Column) -> Column:
        wanted = z["colour"] != F.col("displacement")
        wanted = F.coalesce(wanted, F.lit(cfg.allow_doji))
        return wanted & (z["known_at"] <= F.col("opened_at"))

    out = out.withColumn("earlier", earlier)
    cand = F.try_element_at(F.filter("earlier", fits), F.lit(-1 if cfg.block_nearest else 1))
    out = out.withColumn("cand", F.when(F.col("displacement").isNotNull(), F.struct(*[cand[f].alias(f) for f in ("i", "lo", "hi")])))
    event = F.when(F.col("displacement") == "bullish", F.col("event_up")).otherwise(F.col("event_down"))
    match cfg.block_structure:
        case "bos_or_choch":
            wanted = event.isNotNull()
        case "bos":
            wanted = event == "BOS"
        case "choch":
            wanted = event == "CHoCH"
        case _:
            wanted = F.lit(True)
    beyond = F.when(F.col("displacement") == "bullish", F.col("close") > F.col("cand.hi")).otherwise(F.col("close") < F.col("cand.lo"))
    out = out.withColumn("formed", F.when(F.coalesce(wanted & beyond & F.col("displacement").isNotNull(), F.lit(False)), F.struct(F.col("displacement").alias("dir"), "cand.*")))
    if cfg.require_fvg:
        out = out.withColumn("formed", lag("formed", 1)).withColumn("formed", F.when((F.col("gap") == F.col("formed.dir")) & F.col("gap_displaced"), F.col("formed")))
    out = out.withColumns({"block": F.col("formed.dir"), "block_low": F.col("formed.lo"), "block_high": F.col("formed.hi"), "block_index": F.col("formed.i")})
    return out.drop("zl", "zh", "earlier", "cand", "formed")


def displacement(facts: DataFrame, cfg: Config) -> DataFrame:
    return facts.transform(add_displacement, cfg).transform(add_gaps, cfg).transform(add_blocks, cfg)


