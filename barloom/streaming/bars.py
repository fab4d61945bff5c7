"""Candles and their facts on streams.

Bars come from an event stream with a watermark; events beyond it are left out, and go to a table of
their own where late_events runs ahead. Facts follow bar by bar with keyed state of bounded size: the last few bars, the swings in force and the
open outcomes of a series. Whatever the micro-batches, the rows are those of the batch plan.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.functions.core import PRICE, TIMEFRAMES
from barloom.plans.config import Config

FACTS = (
    "series_key string, bar_index long, opened_at timestamp, close double, swing_high double, swing_low double, trend string, ready boolean, event_up string, event_down string, "
    "missing_before long, finalized_index long, outcome string, htf_direction string, ignored string"
)


def stream_bars(events: DataFrame, timeframe: str, delay: str) -> DataFrame:
    """Bars of an event stream (symbol, ts, tie, price, volume), complete once the watermark has passed them."""
    rows = events.where("price > 0").withWatermark("ts", delay)
    order = F.struct("ts", "tie")
    price = F.col("price").cast(PRICE)
    return (
        rows.groupBy(F.window("ts", f"{TIMEFRAMES[timeframe]} seconds").alias("w"), "symbol")
        .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum("volume").alias("volume"))
        .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("w.start").alias("opened_at"), "open", "high", "low", "close", "volume")
    )


def closed_bars(bars: DataFrame, delay: str) -> DataFrame:
    """A stream of bars without the repeats of a feed that sends its last ones again."""
    return bars.withWatermark("opened_at", delay).dropDuplicatesWithinWatermark(["series_key", "opened_at"])


class Series:
    """The facts of one series as far as it has come."""

    def __init__(self, cfg: Config, seconds: int) -> None:
        self.cfg, self.seconds = cfg, seconds
        self.index, self.tail, self.last_open = -1, [], None
        self.swings: dict[str, list] = {"high": [], "low": []}
        self.used = {"high": True, "low": True}
        self.trend, self.waiting, self.higher = "ranging", [], None

    def ready(self) -> bool:
        return all(len(v) == 2 for v in self.swings.values())

    def see_higher(self, available_at, direction: str) -> None:
        """A higher bar, seen by bars that open at or after its close."""
        self.higher = (available_at, direction)

    def step(self, opened_at, high, low, close) -> dict | None:
        """The facts of the next bar; None for one that isn't newer than the last."""
        if self.last_open is not None and opened_at <= self.last_open:
            return None
        gap = 0 if self.last_open is None else max(0, -(-int((opened_at - self.last_open).total_seconds() - self.seconds) // self.seconds))
        self.index, self.last_open = self.index + 1, opened_at
        out = {"bar_index": self.index, "opened_at": opened_at, "close": close, "missing_before": gap, "event_up": None, "event_down": None}
        before = self.tail[-1][2] if self.tail else None
        for side, name, other in (("high", "event_up", "bullish"), ("low", "event_down", "bearish")):
            level = self.swings[side][-1] if self.swings[side] else None
            crossed = before is not None and level is not None and (before <= level < close if side == "high" else before >= level > close)
            if crossed and not self.used[side]:
                self.used[side] = True
                out[name] = None if self.trend == "ranging" else "BOS" if self.trend == other else "CHoCH"
        length = self.cfg.fractal_length
        self.tail = [*self.tail, (high, low, close)][-length:]
        out["swing_high"] = out["swing_low"] = None
        if len(self.tail) == length:
            r = length // 2
            for side, at, best in (("high", 0, max), ("low", 1, min)):
                values = [b[at] for b in self.tail]
                middle, others = values[r], values[:r] + values[r + 1 :]
                if best(others) != middle and best([middle, *others]) == middle:
                    out["swing_" + side] = middle
                    self.swings[side] = [*self.swings[side], middle][-2:]
                    self.used[side] = False
        (h, l) = (self.swings["high"], self.swings["low"])  # noqa: E741
        if self.ready():
            self.trend = "bullish" if h[1] > h[0] and l[1] > l[0] else "bearish" if h[1] < h[0] and l[1] < l[0] else "ranging"
        out |= {"trend": self.trend, "ready": self.ready(), "finalized_index": None, "outcome": None}
        self.waiting.append((self.index, close))
        if self.waiting[0][0] == self.index - self.cfg.horizon:
            i, entry = self.waiting.pop(0)
            out |= {"finalized_index": i, "outcome": "WIN" if close > entry else "LOSS" if close < entry else "FLAT"}
        out["htf_direction"] = self.higher[1] if self.higher and self.higher[0] <= opened_at else None
        return out


def stream_facts(bars: DataFrame, cfg: Config, seconds: int) -> DataFrame:
    """Facts of a stream of bars (series_key, opened_at, high, low, close), in append mode.

    Rows of one micro-batch are taken in time order. A bar that isn't newer than the last of its
    series changes nothing: it comes out without facts, ignored being "repeat" where it opens with
    the last one and "late" where it is older, for split_ignored to tell apart. Optional columns higher_at and higher_direction carry a higher timeframe's
    closed bar, which later bars see.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        series = pickle.loads(state.get[0]) if state.exists else Series(cfg, seconds)
        rows = pd.concat(list(batches)).sort_values("opened_at", kind="stable")
        out = []
        for r in rows.itertuples():
            if getattr(r, "higher_at", None) is not None and not pd.isna(r.higher_at):
                series.see_higher(r.higher_at, r.higher_direction)
            if pd.isna(r.close):
                continue
            fact = series.step(r.opened_at, float(r.high), float(r.low), float(r.close))
            if fact is None:
                why = "repeat" if r.opened_at == series.last_open else "late"
                fact = {"opened_at": r.opened_at, "close": float(r.close), "ignored": why}
            out.append({"series_key": key[0], **fact})
        state.update((pickle.dumps(series),))
        if out:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in FACTS.split(", ")])
            longs = [c.split()[0] for c in FACTS.split(", ") if c.endswith(" long")]
            yield frame.astype({**dict.fromkeys(longs, "Int64"), "ready": "boolean"})

    return bars.groupBy("series_key").applyInPandasWithState(step, FACTS, "series binary", "append", GroupStateTimeout.NoTimeout)


def split_ignored(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, bars that came late or again), for a sink of each."""
    return facts.where("ignored IS NULL").drop("ignored"), facts.where("ignored IS NOT NULL").select("series_key", "opened_at", "close", "ignored")


def late_counts(ignored: DataFrame) -> DataFrame:
    """How many bars of each series came late or again, and the first and last of them."""
    return ignored.groupBy("series_key", "ignored").agg(F.count("*").alias("n"), F.min("opened_at").alias("first"), F.max("opened_at").alias("last"))


def publish_once(path: str):
    """A foreachBatch sink of rows with series_key and bar_index, each bar's published by one epoch alone.

    An epoch's rows are one folder, replaced as a whole when its batch runs again. Beside them lies
    an index written last: how far each series had been published after each epoch, a row for each
    series. A batch looks at the index of the epoch before it, not at the rows, and leaves out bars
    that lie within; so a batch that died between its two writes does both again with the same result.
    ``published`` reads what epochs with an index hold.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            known = _index(batch.sparkSession, path, epoch)
            rows = batch.dropDuplicates(["series_key", "bar_index"])
            if known is not None:
                rows = rows.join(known, "series_key", "left").where("newest IS NULL OR bar_index > newest").drop("newest")
            rows.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
            ends = batch.select("series_key", F.col("bar_index").alias("newest"))
            ends = ends if known is None else ends.unionByName(known)
            ends.groupBy("series_key").agg(F.max("newest").alias("newest")).write.mode("overwrite").parquet(f"{path}/index/epoch={epoch}")
        finally:
            batch.unpersist()

    return write


def read_epochs(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of epochs, or None before the first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _index(spark: SparkSession, path: str, epoch: int) -> DataFrame | None:
    """(series_key, newest) after the last epoch before this one."""
    index = read_epochs(spark, f"{path}/index")
    last = None if index is None else index.where(F.col("epoch") < epoch).agg(F.max("epoch")).first()[0]
    return None if last is None else index.where(F.col("epoch") == last).select("series_key", "newest")


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of the epochs that are complete, with their epoch; None before the first."""
    index = read_epochs(spark, f"{path}/index")
    if index is None:
        return None
    done = index.select("epoch").distinct()
    return spark.read.parquet(f"{path}/rows").join(F.broadcast(done), "epoch", "left_semi")  # a number for each epoch


def late_events(spark: SparkSession, path: str, delay: str, name: str = "late"):
    """A foreachBatch step for events (ts) ahead of stream_bars: those older than the watermark go to a table.

    The watermark is the one that Spark keeps: the newest time of all batches before, less the delay. A
    batch's own newest time is written for the next ones to read, by epoch, so a batch that runs again
    splits its events alike. Returns split(batch, epoch), which gives the events still in time.
    """
    margin = F.expr(f"INTERVAL {delay}")

    def split(batch: DataFrame, epoch: int) -> DataFrame:
        marks = read_epochs(spark, f"{path}/marks")
        mark = None if marks is None else marks.where(F.col("epoch") < epoch).agg(F.max("newest")).first()[0]
        batch.agg(F.max("ts").alias("newest")).where("newest IS NOT NULL").write.mode("overwrite").parquet(f"{path}/marks/epoch={epoch}")
        if mark is None:
            return batch
        over = F.col("ts") < F.lit(mark) - margin
        batch.where(over).write.mode("overwrite").parquet(f"{path}/{name}/epoch={epoch}")
        return batch.where(~F.coalesce(over, F.lit(False)))

    return split
