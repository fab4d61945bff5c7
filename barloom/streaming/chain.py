"""The whole chain on a stream of bars: structure to signals, pools, sweeps and outcomes, in foreachBatch.

A micro-batch is a chunk of every series that has new bars in it. The layers are those of the batch
plan; what they know of earlier bars comes from tables of the epoch before:

* tail: the last bars of each series, as many as any layer looks back or ahead (``reach``);
* carry: a row for each series with its last two swings, trend and the newest levels crossed;
* pools: those that are still active;
* setups: those published that may come again.

State is columns of their own types in Parquet, dealt and joined like any table, so no task holds
more than a series' new bars and its tail. An epoch writes its results and state as folders of its
own, replaced as a whole when its batch runs again, and marks itself done last; a batch reads the
last epoch done before it. So a batch that died part-way is done again with the same result. State
older than one epoch is deleted. The state of all series is written in each epoch; with many series and
few new bars, longer triggers make that cheaper.

Whatever the cuts into batches, the rows are those of the batch plan, if each series comes in time
order and a higher bar comes no later than the bars that open at its close or after, and no more than
``reach`` bars of its own ahead of them. Defined cases: a bar that isn't newer than the last of its series, or that a
batch holds again, changes nothing and goes to the table ignored; of bars with one time in a batch the first
by availability and prices counts; an empty batch changes nothing; other columns of bars are left out; a null symbol,
key or time goes to ignored, too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.core import lag, series
from barloom.operators import context, displacement, liquidity, outcomes, ranges, signals, structure
from barloom.plans.config import Config
from barloom.streaming.bars import read_epochs

SIDES = ("high", "low")
#: Columns of a bar.
BAR = ("series_key", "symbol", "timeframe", "opened_at", "closed_at", "available_at", "open", "high", "low", "close", "volume")
#: What a bar's structure adds to it.
STRUCTURE = ("prev_close", *[f"{k}_{s}" for k in ("swing", "prior", "last") for s in SIDES], "ready", "trend", "prev_ready", "prev_trend", "event_up", "event_down")
FACTS = (*BAR, "bar_index", *STRUCTURE)
#: Results, by table.
RESULTS = ("facts", "outcomes", "pools", "ignored")


def reach(cfg: Config) -> int:
    """How many bars of a series any layer looks back, or an outcome ahead."""
    return max(cfg.fractal_length, cfg.atr_period + max(cfg.candidate_lookback, 2) + 4, cfg.sweep_lookback, cfg.horizon, 4 * cfg.regime_period + 1)


class Epoch:
    """The tables of one epoch, and those of the last one done before it."""

    def __init__(self, spark: SparkSession, path: str, epoch: int) -> None:
        self.spark, self.path, self.epoch = spark, path, epoch
        done = read_epochs(spark, f"{path}/done")
        self.last = None if done is None else done.where(F.col("epoch") < epoch).agg(F.max("epoch")).first()[0]

    def carried(self, name: str) -> DataFrame | None:
        return None if self.last is None else self.spark.read.parquet(f"{self.path}/state/epoch={self.last}/{name}")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df written as this epoch's state and read again."""
        folder = f"{self.path}/state/epoch={self.epoch}/{name}"
        df.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def publish(self, df: DataFrame, name: str) -> DataFrame:
        folder = f"{self.path}/{name}/epoch={self.epoch}"
        df.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def finish(self) -> None:
        """Mark the epoch as done, and delete state that no retry can want."""
        self.spark.range(1).select(F.lit(True).alias("done")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/epoch={self.epoch}")
        jvm = self.spark._jvm.org.apache.hadoop.fs
        folder = jvm.Path(f"{self.path}/state")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in files.listStatus(folder):  # three at most
            if int(status.getPath().getName().split("=")[1]) < (self.epoch if self.last is None else self.last):
                files.delete(status.getPath(), True)


def _numbered(batch: DataFrame, carry: DataFrame | None) -> DataFrame:
    """Bars of a batch with bar_index behind their series' last one; ignored says why a bar has none."""
    known = F.col("series_key").isNotNull() & F.col("symbol").isNotNull() & F.col("opened_at").isNotNull()
    same = Window.partitionBy("series_key", "opened_at").orderBy("available_at", "open", "high", "low", "close", "volume")
    bars = batch.select(*BAR).where(known).withColumn("nth", F.row_number().over(same))
    ends = carry.select("series_key", "last_index", "last_open") if carry is not None else None
    bars = bars.join(ends, "series_key", "left") if ends is not None else bars.withColumns({"last_index": F.lit(None).cast("long"), "last_open": F.lit(None).cast("timestamp")})
    why = F.when((F.col("nth") > 1) | (F.col("opened_at") == F.col("last_open")), "repeat").when(F.col("opened_at") < F.col("last_open"), "late")
    bars = bars.withColumn("ignored", why).withColumn("fresh", F.col("ignored").isNull())
    order = Window.partitionBy("series_key", "fresh").orderBy("opened_at")
    index = F.coalesce(F.col("last_index"), F.lit(-1).cast("long")) + F.row_number().over(order)
    out = bars.withColumn("bar_index", F.when(F.col("fresh"), index)).drop("nth", "last_index", "last_open", "fresh")
    return out.unionByName(batch.select(*BAR).where(~known).withColumns({"ignored": F.lit("no_key"), "bar_index": F.lit(None).cast("long")}))


def _structure(new: DataFrame, tail: DataFrame | None, carry: DataFrame | None, cfg: Config) -> DataFrame:
    """Structure of new bars: swings over the tail, too; trend and breaks from what is carried."""
    both = new.withColumn("new", F.lit(True))
    if tail is not None:
        both = both.unionByName(tail.select(*BAR, "bar_index", F.lit(False).alias("new")))
    swung = structure.add_swings(both, cfg).withColumn("prev_close", lag("close")).where("new").drop("new")
    if carry is not None:
        pairs = {f"carry_pair_{s}": F.when(F.col(f"end.last_{s}").isNotNull(), F.struct(F.col(f"end.last_{s}.price").alias("now"), F.col(f"before_{s}.price").alias("before"))) for s in SIDES}
        before = [*[F.col(f"end.last_{s}").alias(f"carry_{s}") for s in SIDES], *[p.alias(k) for k, p in pairs.items()], *[F.col(f"crossed_{s}").alias(f"carry_crossed_{s}") for s in SIDES]]
        swung = swung.join(carry.select("series_key", F.col("end.ready").alias("carry_ready"), F.col("end.trend").alias("carry_trend"), *before), "series_key", "left")
    return swung.transform(structure.add_trend).transform(structure.add_breaks).select(*FACTS)


def _carry(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """A row for each series: where it ends, the swings before its last ones, and the newest levels crossed."""
    end = F.struct(*[f"last_{s}" for s in SIDES], "ready", "trend")
    before = [F.max_by(F.struct(F.col(f"prior_{s}.price").alias("price")), F.when(F.col(f"swing_{s}").isNotNull(), F.col("bar_index"))).alias(f"before_{s}") for s in SIDES]
    crossed = [F.max(F.when(structure.crosses(s), F.col(f"prior_{s}.confirm"))).alias(f"crossed_{s}") for s in SIDES]
    out = new.groupBy("series_key").agg(F.max("bar_index").alias("last_index"), F.max("opened_at").alias("last_open"), F.max_by(end, "bar_index").alias("end"), *before, *crossed)
    if old is None:
        return out
    was = old.select("series_key", F.struct(*[c for c in old.columns if c != "series_key"]).alias("old"))
    newest = {c: F.coalesce(F.col(c), F.col(f"old.{c}")) for c in out.columns if c != "series_key"}
    return out.join(was, "series_key", "full").withColumns(newest).drop("old")


def _facts(new: DataFrame, tail: DataFrame | None, higher: DataFrame, registry: DataFrame, setups: DataFrame | None, cfg: Config) -> DataFrame:
    """All facts of new bars of the primary timeframe, which have their sweeps."""
    both = new.withColumn("new", F.lit(True))
    if tail is not None:
        both = both.unionByName(tail.select(*FACTS, "sweeps", F.lit(False).alias("new")))
    out = both.transform(displacement.displacement, cfg).transform(ranges.ranges, cfg).transform(liquidity.add_recent_sweeps, cfg).transform(outcomes.add_regime, cfg)
    out = context.add_confluence(out.where("new").drop("new"), {tf: higher.where(F.col("timeframe") == tf) for tf in cfg.higher})
    out = context.add_registry(out, registry, cfg.registry_mode)
    return signals.add_scores(out, cfg).transform(signals.add_votes).transform(signals.add_signals, cfg, setups).transform(signals.add_labels)


def _outcomes(bars: DataFrame, cfg: Config) -> DataFrame:
    """Outcomes that new bars finalize; bars: the tail and what is new, with signal_id."""
    out = outcomes.add_outcomes(bars.withColumn("ends_now", F.lead("new", cfg.horizon).over(series())), cfg)
    columns = ("final_close", "mfe_price", "mfe_index", "mae_price", "mae_index", "mfe_return", "mae_return", "final_return")
    return out.where("ends_now").select("series_key", "symbol", "bar_index", "signal_id", "outcome", *columns)


def _cursors(cfg: Config) -> Column:
    """Where a bar's higher timeframes stand. They only go up, so a setup comes again only while they stay."""
    return F.to_json(F.struct(F.lit(0).alias("first"), *[F.col(f"cursor_{tf}") for tf in cfg.higher]))


def _setups(facts: DataFrame, old: DataFrame | None) -> DataFrame:
    """Setups published so far whose cursors are those of their series' last bar."""
    ends = facts.groupBy("series_key").agg(F.max_by("cursors", "bar_index").alias("now"))
    new = facts.where("signal = 'BUY_SIGNAL'").select("series_key", "setup_id", "cursors")
    every = new if old is None else new.unionByName(old)
    return every.join(ends, "series_key", "left").where("now IS NULL OR now = cursors").drop("now").distinct()


def publish_chain(path: str, primary: str, registry: Callable[[SparkSession], DataFrame], cfg: Config) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that takes bars of all timeframes (those of as_series; no bar_index) and publishes RESULTS below path.

    facts: the bars of the timeframe primary with all facts; outcomes: of each bar, by the epoch that
    finalizes it; pools: when they are breached; ignored: bars left out. One path belongs to one stream.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        e = Epoch(batch.sparkSession, path, epoch)
        tail, carry, pools, setups = (e.carried(name) for name in ("tail", "carry", "pools", "setups"))
        bars = e.keep(_numbered(batch, carry), "bars")
        e.publish(bars.where("ignored IS NOT NULL").drop("bar_index"), "ignored")
        new = e.keep(_structure(bars.where("ignored IS NULL").drop("ignored"), tail, carry, cfg), "structure")
        ends = e.keep(_carry(new, carry), "carry")
        own = F.col("timeframe") == primary
        life = e.keep(liquidity.pools(new.where(own), cfg, pools), "life")
        e.publish(life.where("status <> 'active'"), "pools")
        e.keep(life.where("status = 'active'").join(ends.select("series_key", "last_index"), "series_key"), "pools")
        higher = new if tail is None else new.unionByName(tail.select(*FACTS))
        primaries = None if tail is None else tail.where(own)
        facts = _facts(liquidity.add_sweeps(new.where(own), life), primaries, higher, registry(e.spark), setups, cfg)
        facts = e.publish(facts.withColumn("cursors", _cursors(cfg)), "facts")
        e.keep(_setups(facts, setups), "setups")
        found = facts.select("series_key", "bar_index", "sweeps", "signal_id")
        seen = new.join(found, ["series_key", "bar_index"], "left").select(*FACTS, "sweeps", "signal_id").withColumn("new", F.lit(True))
        seen = seen if tail is None else seen.unionByName(tail.withColumn("new", F.lit(False)))
        e.publish(_outcomes(seen.where(own), cfg), "outcomes")
        last = seen.join(ends.select("series_key", "last_index"), "series_key").where(F.col("bar_index") > F.col("last_index") - reach(cfg))
        e.keep(last.drop("new", "last_index"), "tail")
        e.finish()

    return write


def results(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """One of RESULTS, of all epochs done, with their epoch; None before the first."""
    done = read_epochs(spark, f"{path}/done")
    if done is None:
        return None
    return spark.read.parquet(f"{path}/{name}").join(F.broadcast(done.select("epoch").distinct()), "epoch", "left_semi")  # a number for each epoch


def replay(bars: DataFrame, batches: int, path: str, primary: str, registry: Callable[[SparkSession], DataFrame], cfg: Config) -> None:
    """Bars at hand through the chain in batches of equal spans of the times when they were available."""
    spark, at = bars.sparkSession, F.unix_micros("available_at")
    bars.select(*BAR).write.mode("overwrite").parquet(f"{path}/input")
    held = spark.read.parquet(f"{path}/input")
    first, last = held.select(F.min(at), F.max(at)).first()
    write = publish_chain(path, primary, registry, cfg)
    for k in range(batches):
        cut = F.lit(True) if first is None else F.least(F.floor((at - first) * batches / (last - first + 1)), F.lit(batches - 1)) == k
        write(held.where(cut), k)
