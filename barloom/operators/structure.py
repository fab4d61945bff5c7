"""Fractal swings, trend, and breaks of structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.core import ffill, ffill_prev, lag, rows
from barloom.plans.config import Config


def add_swings(bars: DataFrame, cfg: Config) -> DataFrame:
    """swing_high and swing_low (price, pivot, confirm, known_at) on the bar that confirms them.

    The bar in the middle of fractal_length bars is above (below) all others, ties excluded.
    """
    r = (cfg.fractal_length - 1) // 2
    ready = F.col("bar_index") >= 2 * r
    high, low = lag("high", r), lag("low", r)
    top = F.greatest(F.max("high").over(rows(-2 * r, -r - 1)), F.max("high").over(rows(-r + 1, 0)))
    bottom = F.least(F.min("low").over(rows(-2 * r, -r - 1)), F.min("low").over(rows(-r + 1, 0)))
    out = bars.withColumns({"c_high": high, "c_low": low, "o_top": top, "o_bottom": bottom})

    def swing(price, hit):
        return F.when(ready & hit, F.struct(F.col(price).alias("price"), (F.col("bar_index") - r).alias("pivot"), F.col("bar_index").alias("confirm"), F.col("available_at").alias("known_at")))

    out = out.withColumns({"swing_high": swing("c_high", F.col("c_high") > F.col("o_top")), "swing_low": swing("c_low", F.col("c_low") < F.col("o_bottom"))})
    return out.drop("c_high", "c_low", "o_top", "o_bottom")


def either(first: Column, carried: str, df: DataFrame) -> Column:
    """The value within a chunk, else the one carried into it, where the table has such a column."""
    return F.coalesce(first, F.col(carried)) if carried in df.columns else first


def trend_of(high: Column, low: Column) -> Column:
    """The trend by the last two highs and lows (now, before)."""
    up = (high["now"] > high["before"]) & (low["now"] > low["before"])
    down = (high["now"] < high["before"]) & (low["now"] < low["before"])
    return F.when(up, "bullish").when(down, "bearish").otherwise("ranging")


def ready_of(high: Column, low: Column) -> Column:
    return F.coalesce(high["before"].isNotNull() & low["before"].isNotNull(), F.lit(False))


def add_trend(df: DataFrame) -> DataFrame:
    """trend after this bar from the last two highs and lows, ready, and prev_trend.

    In a chunk of a series carry_<side> and carry_pair_<side> stand for the bars before it.
    """
    out = df
    for side in ("high", "low"):
        out = out.withColumn(f"prior_{side}", either(ffill_prev(F.col(f"swing_{side}")), f"carry_{side}", df))
        pair = F.when(F.col(f"swing_{side}").isNotNull(), F.struct(F.col(f"swing_{side}.price").alias("now"), F.col(f"prior_{side}.price").alias("before")))
        out = out.withColumn(f"last_{side}", either(ffill(F.col(f"swing_{side}")), f"carry_{side}", df)).withColumn(f"pair_{side}", either(ffill(pair), f"carry_pair_{side}", df))
    high, low = F.col("pair_high"), F.col("pair_low")
    out = out.withColumn("ready", ready_of(high, low)).withColumn("trend", F.when(F.col("ready"), trend_of(high, low)).otherwise("ranging"))
    out = out.withColumn("prev_trend", F.coalesce(either(lag("trend"), "carry_trend", df), F.lit("ranging")))
    return out.withColumn("prev_ready", F.coalesce(either(lag("ready"), "carry_ready", df), F.lit(False))).drop("pair_high", "pair_low")


def crosses(side: str) -> Column:
    """Whether the close crosses the level known before this bar."""
    level = F.col(f"prior_{side}.price")
    beyond = (F.col("prev_close") <= level) & (level < F.col("close")) if side == "high" else (F.col("prev_close") >= level) & (level > F.col("close"))
    return F.coalesce(beyond, F.lit(False))


def add_breaks(df: DataFrame) -> DataFrame:
    """event_up and event_down: BOS or CHoCH where the close first crosses the level known before this bar.

    The first crossing uses a level up even where the trend gives it no label. Levels follow one
    another by the bars that confirm them, so a level is used up once that bar, or a later one, is
    among those of crossed levels; in a chunk of a series carry_crossed_<side> stands for those before it.
    """
    out = df if "prev_close" in df.columns else df.withColumn("prev_close", lag("close"))
    for side, kind in (("high", "up"), ("low", "down")):
        with_, against = ("bullish", "bearish") if kind == "up" else ("bearish", "bullish")
        out = out.withColumn("cross", crosses(side))
        used = F.max(F.when(F.col("cross"), F.col(f"prior_{side}.confirm"))).over(rows(Window.unboundedPreceding, -1))
        if f"carry_crossed_{side}" in df.columns:
            used = F.greatest(used, F.col(f"carry_crossed_{side}"))
        first = F.col("cross") & F.coalesce(used < F.col(f"prior_{side}.confirm"), F.lit(True))
        out = out.withColumn("first_cross", first)
        label = F.when(F.col("prev_trend") == with_, "BOS").when(F.col("prev_trend") == against, "CHoCH")
        out = out.withColumn(f"event_{kind}", F.when(F.col("first_cross"), label)).drop("cross", "first_cross")
    return out


def structure(bars: DataFrame, cfg: Config) -> DataFrame:
    return bars.transform(add_swings, cfg).transform(add_trend).transform(add_breaks)


def events(facts: DataFrame) -> DataFrame:
    """One row per labelled break."""
    kinds = F.array(
        F.struct(F.lit("bullish").alias("direction"), F.col("event_up").alias("event"), F.col("prior_high").alias("level")),
        F.struct(F.lit("bearish").alias("direction"), F.col("event_down").alias("event"), F.col("prior_low").alias("level")),
    )
    out = facts.select("series_key", "symbol", "bar_index", "opened_at", F.explode(F.filter(kinds, lambda e: e["event"].isNotNull())).alias("e"))
    return out.select("series_key", "symbol", "bar_index", "opened_at", "e.direction", "e.event", F.col("e.level.price").alias("level"))


