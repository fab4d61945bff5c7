"""Fixed-horizon outcomes, indicators and regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.chunks import KEYS, affine, place, within
from barloom.functions.core import lag, rows, series, upto
from barloom.plans.config import Config

#: Bars of a chunk of recurrences: decays over as many stay within doubles.
RECURRENCE = 256


def add_outcomes(df: DataFrame, cfg: Config) -> DataFrame:
    """outcome, final_close, best and worst with their bars, and returns of a long entry at this bar's close."""
    h = cfg.horizon
    ahead = rows(1, h)
    out = df.withColumn("observed", F.count("*").over(ahead)).withColumn("final_close", F.lead("close", h).over(series()))
    # ties keep the first bar
    out = out.withColumn("best", F.max(F.struct(F.col("high").alias("price"), (-F.col("bar_index")).alias("at"))).over(ahead)).withColumn("worst", F.min(F.struct(F.col("low").alias("price"), F.col("bar_index").alias("at"))).over(ahead))
    state = F.when(F.col("final_close").isNull(), "OPEN").when(F.col("final_close") > F.col("close"), "WIN").when(F.col("final_close") < F.col("close"), "LOSS").otherwise("FLAT")
    close = F.col("close").cast("double")
    return out.withColumn("outcome", state).withColumns({
        "mfe_price": F.col("best.price"), "mfe_index": -F.col("best.at"), "mae_price": F.col("worst.price"), "mae_index": F.col("worst.at"),
        "mfe_return": (F.col("best.price").cast("double") - close) / close, "mae_return": (F.col("worst.price").cast("double") - close) / close, "final_return": (F.col("final_close").cast("double") - close) / close,
    }).drop("best", "worst")


def outcome_aggregates() -> list[Column]:
    """Counts, win rate and average returns over outcome rows; null where nothing is finalized."""
    done = F.col("outcome") != "OPEN"
    finalized = F.count_if(done)
    return [
        F.count("outcome").alias("total"), F.count_if(F.col("outcome") == "OPEN").alias("open"), F.count_if(F.col("outcome") == "WIN").alias("win"), F.count_if(F.col("outcome") == "LOSS").alias("loss"),
        F.count_if(F.col("outcome") == "FLAT").alias("flat"), finalized.alias("finalized"), F.try_divide(F.count_if(F.col("outcome") == "WIN"), finalized).alias("win_rate"),
        F.avg(F.when(done, F.col("final_return"))).alias("avg_return"), F.avg(F.when(done, F.col("mfe_return"))).alias("avg_mfe"), F.avg(F.when(done, F.col("mae_return"))).alias("avg_mae"),
    ]


def outcome_log(signals: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """The outcomes' change log: created on the signal's bar, evaluated on each bar after, completed at the horizon."""
    steps = signals.select("signal_id", "series_key", "bar_index", F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("step"))
    at = bars.select("series_key", F.col("bar_index").alias("at"))
    steps = steps.withColumn("at", F.col("bar_index") + F.col("step")).join(at, ["series_key", "at"])
    return steps.select("signal_id", "series_key", F.col("at").alias("bar_index"), F.when(F.col("step") == 0, "created").when(F.col("step") == horizon, "completed").otherwise("evaluated").alias("version"), "step")


def latest_versions(log: DataFrame) -> DataFrame:
    return log.groupBy("signal_id").agg(F.max_by("version", "step").alias("version"), F.max("step").alias("step"))


def running(signals_with_outcomes: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Open and finalized outcomes as known at each bar."""
    begun = signals_with_outcomes.select("series_key", "bar_index", F.lit(1).alias("begun"), F.lit(0).alias("done"), F.lit(0).alias("won"))
    ended = signals_with_outcomes.where("outcome <> 'OPEN'").select("series_key", (F.col("bar_index") + horizon).alias("bar_index"), F.lit(0).alias("begun"), F.lit(1).alias("done"), (F.col("outcome") == "WIN").cast("int").alias("won"))
    sums = begun.unionByName(ended).groupBy("series_key", "bar_index").agg(*[F.sum(c).alias(c) for c in ("begun", "done", "won")])
    w = Window.partitionBy("series_key").orderBy("bar_index")
    out = bars.select("series_key", "bar_index").join(sums, ["series_key", "bar_index"], "left")
    out = out.withColumns({c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(w) for c in ("begun", "done", "won")})
    return out.select("series_key", "bar_index", (F.col("begun") - F.col("done")).alias("open"), F.col("done").alias("finalized"), F.col("won").alias("win"))


def add_volume_ratio(df: DataFrame, cfg: Config) -> DataFrame:
    p = cfg.volume_period
    mean = F.when(F.col("bar_index") >= p - 1, F.avg(F.col("volume").cast("double")).over(rows(-(p - 1), 0)))
    return df.withColumn("volume_average", mean).withColumn("volume_ratio", F.try_divide(F.col("volume").cast("double"), F.col("volume_average")))


def ema_rsi(bars: DataFrame, cfg: Config, size: int = RECURRENCE) -> DataFrame:
    """ema_<p> and rsi of every bar.

    Both are recurrences x -> a x + b with a = 1 while they fill and one decay afterwards. In a chunk
    of `size` bars x is a running sum of the b, each grown by the decays before it, and decayed at
    once; the state that a chunk starts with comes from the composed steps of the chunks before.
    """
    n, i = cfg.rsi_period, F.col("bar_index")
    # name: (decay, first bar that decays, what the bar adds)
    steps = {f"ema_{p}": ((p - 1) / (p + 1), p, F.when(i < p, F.col("close") / p).otherwise(F.col("close") * 2 / (p + 1))) for p in cfg.ema_periods}
    steps |= {side: ((n - 1) / n, n + 1, F.coalesce(F.greatest(sign * F.col("change"), F.lit(0.0)) / n, F.lit(0.0))) for side, sign in (("gain", 1), ("loss", -1))}
    carried = [name for name, (decay, _, _) in steps.items() if decay]  # without a decay left, the last bar is all

    def decays(name: str) -> Column:
        return F.pow(F.lit(steps[name][0]), F.greatest(F.lit(0), i - F.greatest(F.col("chunk") * size, F.lit(steps[name][1])) + 1))

    def sums(df: DataFrame) -> DataFrame:
        out = df.withColumn("change", F.col("close") - lag("close")).where(F.col("chunk") == place(size))
        return out.withColumns({name: F.sum(add / decays(name)).over(upto()) if name in carried else add for name, (_, _, add) in steps.items()})

    parts = within(bars.select("series_key", "bar_index", F.col("close").cast("double").alias("close")), size, 1, 0, sums)
    out = parts
    if carried:
        ends = parts.groupBy(*KEYS).agg(*[F.max_by(F.struct(decays(name).alias("a"), (decays(name) * F.col(name)).alias("b")), "bar_index").alias(name) for name in carried])
        starts = affine(ends, carried).withColumnsRenamed({name: f"start_{name}" for name in carried})
        out = parts.join(starts, list(KEYS)).withColumns({name: decays(name) * (F.col(f"start_{name}") + F.col(name)) for name in carried})
    emas = [F.when(i >= p - 1, F.col(f"ema_{p}")).alias(f"ema_{p}") for p in cfg.ema_periods]
    flat = (F.col("gain") == 0) & (F.col("loss") == 0)
    rsi = F.when(flat, 50.0).when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(F.col("gain"), F.col("loss"))))
    return out.select("series_key", "bar_index", *emas, F.when(i >= n, rsi).alias("rsi"))


def add_regime(df: DataFrame, cfg: Config) -> DataFrame:
    """efficiency, volatility and regime; null until 4n + 1 closes are there."""
    n = cfg.regime_period
    close = F.col("close").cast("double")
    out = df.withColumn("move", F.abs(close - lag("close").cast("double")))
    path = F.sum("move").over(rows(-(n - 1), 0))
    warm = F.col("bar_index") >= 4 * n
    out = out.withColumn("efficiency", F.when(F.col("bar_index") >= n, F.when(path > 0, F.abs(close - F.lag(close, n).over(series())) / path).otherwise(0.0)))
    out = out.withColumn("volatility", F.when(warm, F.try_divide(F.avg("move").over(rows(-(n - 1), 0)), F.avg("move").over(rows(-(4 * n - 1), 0)))))
    regime = F.when(F.col("efficiency") >= cfg.trending_ratio, "TRENDING").when(F.col("volatility") >= cfg.high_volatility, "HIGH_VOLATILITY").when(F.col("volatility") <= cfg.low_volatility, "LOW_VOLATILITY").otherwise("RANGING")
    return out.withColumn("regime", F.when(warm & F.col("volatility").isNotNull(), regime)).drop("move")
