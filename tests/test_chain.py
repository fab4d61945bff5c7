"""The streamed chain gives the rows of the batch plan, however the bars are cut into batches."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from barloom.functions.core import PRICE
from barloom.operators import liquidity
from barloom.plans import facts as P
from barloom.plans.config import Config
from barloom.sources import candles
from barloom.streaming import chain

START = datetime(2024, 1, 1)
CFG = Config(fractal_length=3, score_threshold=20, atr_period=5, min_range_atr=1.0, min_body_atr=0.5, higher=("1h",), horizon=4, regime_period=5, sweep_lookback=6, candidate_lookback=4)


def listed(spark):
    return spark.createDataFrame([("click",), ("view",)], "symbol string")


def walk(seed, n, step=6):
    rng = random.Random(seed)
    price, out = 100.0, []
    for _ in range(n):
        o, c = price, max(20.0, price + rng.randint(-step, step))
        out.append((o, max(o, c) + rng.randint(0, 3), min(o, c) - rng.randint(0, 3), c))
        price = c
    return out


def bars_of(spark, n=120):
    """(15-minute bars, hourly bars) of three symbols, one of which isn't listed."""
    data = [(s, START + timedelta(minutes=15 * i), *r) for k, s in enumerate(("click", "view", "zoom")) for i, r in enumerate(walk(k, n))]
    low = spark.createDataFrame(data, "symbol string, opened_at timestamp, open double, high double, low double, close double")
    low = low.select("symbol", F.lit("15m").alias("timeframe"), "opened_at", *[F.col(c).cast(PRICE).alias(c) for c in ("open", "high", "low", "close")], F.lit(1).cast(PRICE).alias("volume"))
    hour = low.groupBy("symbol", F.window("opened_at", "1 hour").alias("w")).agg(F.min_by("open", "opened_at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "opened_at").alias("close"), F.sum("volume").cast(PRICE).alias("volume"))
    hour = hour.select("symbol", F.lit("1h").alias("timeframe"), F.col("w.start").alias("opened_at"), "open", "high", "low", "close", "volume")
    return candles.as_series(low, "15m").persist(), candles.as_series(hour, "1h").persist()


@pytest.fixture(scope="module")
def feed(spark):
    return bars_of(spark)


def rows_of(df, columns):
    return sorted((tuple(str(x) for x in r) for r in df.select(*columns).collect()))


def expect(spark, feed, path, cfg):
    """All results below path are those of the batch plan over the feed."""
    low, hour = feed
    batch = P.signal_facts(low, {"1h": hour}, listed(spark), cfg).persist()
    left = {"trades", "observed", "final_close", "outcome", "mfe_price", "mfe_index", "mae_price", "mae_index", "mfe_return", "mae_return", "final_return"}
    columns = [c for c in batch.columns if c not in left]
    got = chain.results(spark, path, "facts")
    assert set(columns) <= set(got.columns)
    want = rows_of(batch, columns)
    assert rows_of(got, columns) == want
    assert {"BUY_SIGNAL", "NO_SIGNAL"} <= {r.signal for r in got.select("signal").distinct().collect()}
    ended = ["series_key", "bar_index", "signal_id", "outcome", "final_close", "mfe_index", "mae_index", "mfe_return", "mae_return", "final_return"]
    assert rows_of(chain.results(spark, path, "outcomes"), ended) == rows_of(batch.where("outcome <> 'OPEN'"), ended)
    life = liquidity.pools(batch, cfg)
    kept = ["series_key", "side", "price", "lower", "upper", "created_index", "touched_index", "members", "known_at", "breach_index", "kind", "status", "reason", "extreme"]
    closed = rows_of(life.where("status <> 'active'"), kept)
    assert rows_of(chain.results(spark, path, "pools"), kept) == closed and closed
    batch.unpersist()


def batches(feed, cuts):
    """The feed in the order in which bars are available, cut at these shares."""
    low, hour = feed
    both = low.select(*chain.BAR).unionByName(hour.select(*chain.BAR))
    times = [r[0] for r in both.select("available_at").distinct().orderBy("available_at").collect()]
    ends = [START, *[times[int(c * len(times))] for c in cuts], times[-1] + timedelta(1)]
    return [both.where((F.col("available_at") >= F.lit(a)) & (F.col("available_at") < F.lit(b))) for a, b in zip(ends, ends[1:], strict=False)]


@pytest.mark.parametrize(("cuts", "changed"), [((0.02, 0.5), {}), ((0.4,), {"pool_tolerance_bps": 150.0, "require_fvg": True})])
def test_rows_of_the_batch_plan(spark, feed, tmp_path, cuts, changed):
    cfg = Config(**{**CFG.__dict__, **changed})
    path = f"file://{tmp_path}/chain"
    write = chain.publish_chain(path, "15m", listed, cfg)
    for epoch, part in enumerate(batches(feed, cuts)):
        write(part, epoch)
    expect(spark, feed, path, cfg)


def test_repeats_late_bars_retries_and_a_batch_that_dies(spark, feed, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/chain"
    write = chain.publish_chain(path, "15m", listed, CFG)
    assert chain.results(spark, path, "facts") is None
    one, two, three = batches(feed, (0.4, 0.7))
    write(one, 0)
    whole = DataFrameWriter.parquet

    def dies(self, target, *args, **kw):
        if "/outcomes/epoch=1" in target:
            raise OSError("killed")
        return whole(self, target, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(OSError, match="killed"):
        write(two, 1)
    monkeypatch.undo()
    assert chain.results(spark, path, "facts").agg(F.max("epoch")).first()[0] == 0
    nobody = two.limit(1).withColumn("symbol", F.lit(None).cast("string"))
    last = one.where(F.col("series_key") == "click:15m:local:events:default").orderBy(F.desc("opened_at")).limit(2)
    write(two.unionByName(two.limit(2)).unionByName(nobody).unionByName(last).withColumn("known", F.lit(1)), 1)
    write(two.unionByName(two.limit(2)).unionByName(nobody).unionByName(last), 1)  # done already, but asked for again
    write(three.where("false"), 2)
    write(three, 3)
    expect(spark, feed, path, CFG)
    left_out = {r.ignored: r.n for r in chain.results(spark, path, "ignored").groupBy("ignored").agg(F.count("*").alias("n")).collect()}
    assert left_out == {"repeat": 3, "late": 1, "no_key": 1}
    assert len(list((tmp_path / "chain" / "state").glob("epoch=*"))) == 2


def test_through_a_stream_that_restarts(spark, feed, tmp_path):
    path, folder = f"file://{tmp_path}/chain", f"{tmp_path}/in"
    low, hour = feed
    both = low.select(*chain.BAR).unionByName(hour.select(*chain.BAR))
    for part in batches(feed, (0.55,)):
        part.coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(both.schema).parquet(folder)
        query = source.writeStream.foreachBatch(chain.publish_chain(path, "15m", listed, CFG)).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(200)
        query.stop()
    expect(spark, feed, path, CFG)


def test_no_bars(spark, feed, tmp_path):
    chain.replay(feed[0].where("false"), 1, f"file://{tmp_path}/empty", "15m", listed, CFG)
    assert all(chain.results(spark, f"file://{tmp_path}/empty", name).count() == 0 for name in chain.RESULTS)
