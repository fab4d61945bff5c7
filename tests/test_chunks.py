"""Series in chunks give the rows of whole series."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from barloom.functions import chunks
from barloom.functions.core import windows_by
from barloom.operators import context, outcomes
from barloom.plans import facts as P
from barloom.plans.config import Config
from barloom.sources import candles

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def noise(spark, n, seed=1, symbols=("aa", "bb")):
    """Random bars, with stretches of rising and falling prices and of equal ones, and holes in time."""
    rng, rows = random.Random(seed), []
    for s in symbols:
        price, at, drift = 100.0, START, 0.0
        for i in range(n):
            if i % 40 == 0:
                drift = rng.choice([-1.5, -0.3, 0, 0, 0.3, 1.5])
            price = max(5.0, price + drift + rng.uniform(-3, 3) * (i % 400 > 20))
            jump = rng.choice([-12, 12]) if rng.random() < 0.06 else 0
            close = max(1.0, price + (jump or rng.uniform(-2, 2)) * (i % 400 > 20))
            high, low = max(price, close) + rng.choice([0, 1, 2]), min(price, close) - rng.choice([0, 0.5, 0.9])
            at += timedelta(minutes=15 * (1 if rng.random() < 0.95 else rng.randrange(2, 30)))
            rows.append((s, at, *(Decimal(f"{x:.2f}") for x in (price, high, max(low, 0.01), close)), Decimal(rng.randrange(0, 9))))
            price = close
    df = spark.createDataFrame(rows, "symbol string, opened_at timestamp, open decimal(18,8), high decimal(18,8), low decimal(18,8), close decimal(18,8), volume decimal(18,8)")
    return df.withColumns({"timeframe": F.lit("15m"), "trades": F.lit(1)})


def rows_of(df):
    return sorted(str(r.asDict(True)) for r in df.select(*sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def bars(spark):
    return candles.as_series(noise(spark, 1100), "15m").persist()


@pytest.mark.parametrize("size", [3, 64, 1000])
def test_structure_in_chunks(bars, size):
    b = bars if size > 3 else bars.where("bar_index < 150")
    assert rows_of(P.structure_facts(b, Config(chunk_bars=size))) == rows_of(P.structure_facts(b, Config()))


@pytest.mark.parametrize(("size", "options"), [(64, {}), (64, {"require_fvg": True, "candidate_lookback": 4, "block_nearest": False, "fractal_length": 3}), (1000, {})])
def test_facts_in_chunks(bars, size, options):
    want = P.bar_facts(bars, Config(**options))
    assert rows_of(P.bar_facts(bars, Config(**options, chunk_bars=size))) == rows_of(want)
    assert want.where("block IS NOT NULL").count() > 3
    assert want.where("shift IS NOT NULL").count() > 3


def test_signals_in_chunks(spark, bars):
    """The whole chain, its higher timeframes included."""
    registry = spark.createDataFrame([("aa",)], "symbol string")
    hours = candles.as_series(noise(spark, 300, 2).withColumn("opened_at", F.lit(START) + (F.col("opened_at") - F.lit(START)) * 4).withColumn("opened_at", F.date_trunc("hour", "opened_at")).dropDuplicates(["symbol", "opened_at"]), "1h")
    found = [P.signal_facts(bars, {"1h": hours}, registry, Config(higher=("1h",), score_threshold=20, chunk_bars=size)) for size in (None, 64)]
    assert rows_of(found[1]) == rows_of(found[0])
    assert found[0].where("signal = 'BUY_SIGNAL'").count() > 3


def test_chunks_are_more_tasks_than_series(spark, bars):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        facts = P.structure_facts(bars, Config(chunk_bars=64)).withColumn("task", F.spark_partition_id())
        tasks = facts.groupBy("task").agg(F.count("event_up"), F.count("event_down")).collect()  # breaks come last: the tasks are theirs
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 2


def test_reach_of_overlaps(bars):
    """A layer that looks further than it says is found out by the rows at the edges of chunks."""
    with windows_by("series_key"):
        want = rows_of(bars.transform(outcomes.add_outcomes, Config()))
    layer = lambda b: b.transform(outcomes.add_outcomes, Config())
    assert rows_of(chunks.within(bars, 50, 0, 10, layer).drop("chunk")) == want
    assert rows_of(chunks.within(bars, 50, 0, 9, layer).drop("chunk")) != want


def test_numbering_by_spans(bars):
    again = chunks.numbered(bars.drop("bar_index"), 3600)
    assert rows_of(again) == rows_of(bars)


@pytest.mark.parametrize("span", [900, 7200, 10**7])
def test_as_of_by_spans(bars, span):
    other = bars.where("bar_index % 7 = 3").withColumn("trend", F.col("close"))
    plain = context.as_of(bars, other, ["trend"], "o")
    assert rows_of(context.as_of(bars, other, ["trend"], "o", span=span)) == rows_of(plain)
    assert rows_of(context.as_of(bars, other.where("false"), ["trend"], "o", span=span)) == rows_of(context.as_of(bars, other.where("false"), ["trend"], "o"))


def plain_ema_rsi(close, periods, n):
    """Bar by bar, by the definitions."""
    out = []
    emas, gain, loss = dict.fromkeys(periods), 0.0, 0.0
    for i, c in enumerate(close):
        for p in periods:
            emas[p] = sum(close[:p]) / p if i == p - 1 else None if i < p else emas[p] + (c - emas[p]) * 2 / (p + 1)
        up, down = (max(c - close[i - 1], 0.0), max(close[i - 1] - c, 0.0)) if i else (0.0, 0.0)
        gain, loss = (gain + up / n, loss + down / n) if i <= n else ((gain * (n - 1) + up) / n, (loss * (n - 1) + down) / n)
        rsi = None if i < n else 50.0 if gain == loss == 0 else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
        out.append((*(emas[p] for p in periods), rsi))
    return out


@pytest.mark.parametrize(("size", "periods", "n"), [(256, (20, 50), 14), (5, (20, 1, 2), 3), (7, (1,), 1)])
def test_recurrences_by_composed_steps(spark, bars, size, periods, n):
    cfg = Config(ema_periods=periods, rsi_period=n)
    flat = bars.where("bar_index < 60").withColumns({"series_key": F.lit("flat"), "symbol": F.lit("flat"), "close": F.lit("7").cast("decimal(18,8)")}).dropDuplicates(["bar_index"])
    rising = flat.withColumns({"series_key": F.lit("rising"), "close": (F.col("bar_index") + 1).cast("decimal(18,8)")})
    every = bars.unionByName(flat).unionByName(rising)
    got = {(r.series_key, r.bar_index): r[2:] for r in outcomes.ema_rsi(every, cfg, size).collect()}
    assert len(got) == every.count()
    for key in [r[0] for r in every.select("series_key").distinct().collect()]:
        close = [float(r[0]) for r in every.where(F.col("series_key") == key).orderBy("bar_index").select("close").collect()]
        for i, want in enumerate(plain_ema_rsi(close, periods, n)):
            assert got[key, i] == pytest.approx(want, abs=1e-9)


def test_recurrences_over_many_levels(spark):
    """Steps of more nodes than one level holds."""
    df = spark.range(700).select(F.lit("s").alias("series_key"), F.col("id").alias("chunk"), F.struct(F.lit(0.5).alias("a"), F.col("id").cast("double").alias("b")).alias("x"))
    got = {r.chunk: r.x for r in chunks.affine(df, ["x"], fan=4, levels=3).collect()}
    state = 0.0
    for k in range(700):
        assert got[k] == pytest.approx(state, abs=1e-9)
        state = 0.5 * state + k
    assert len(got) == 700


def test_recurrences_use_no_python(spark, bars):
    plan = outcomes.ema_rsi(bars, Config())._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan
