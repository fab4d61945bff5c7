"""Continuity, aggregates of conditions, durations, unions, records, and reports' small checks."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.plans import reports as R
from barloom.plans.config import Config
from barloom.sources import candles, quality
from tests.test_chunks import noise

START = datetime(2024, 1, 1)


def opened(spark, *rows):
    return spark.createDataFrame([(k, START + timedelta(minutes=m)) for k, m in rows], "series_key string, opened_at timestamp")


def test_continuity_between_what_was_seen_and_what_is_new(spark):
    seen = opened(spark, ("a", 0), ("a", 15), ("b", 0), ("c", 0))
    new = opened(spark, ("a", 75), ("a", 90), ("b", 15), ("c", 165), ("d", 900))
    got = {r.series_key: (r.expected_at, r.actual_at, r.missing, r.recoverable) for r in quality.continuity_gaps(seen, new, 900, 3).collect()}
    at = lambda m: START + timedelta(minutes=m)
    assert got == {"a": (at(30), at(75), 3, True), "c": (at(15), at(165), 10, False)}


def test_aggregates_merge_as_if_counted_at_once(spark):
    rows = [("x", 5), ("x", 1), ("y", 2), ("x", 9), ("y", 2)]
    every = spark.createDataFrame(rows, "event_id string, seen_at long")
    parts = [quality.aggregated(every.where(f"seen_at {test}")) for test in ("< 2", "= 2", "> 2")]
    assert sorted(quality.merged_aggregates(*parts).collect()) == sorted(quality.aggregated(every).collect()) == [("x", 3, 1, 9), ("y", 2, 2, 2)]


def test_durations(spark):
    df = spark.createDataFrame([("a", 10), ("a", 30), ("a", None), ("b", None)], "stage string, took long")
    got = {r.stage: tuple(r)[1:] for r in quality.durations(df, F.col("took"), "stage").collect()}
    assert got == {"a": (2, 40, 10, 30, 20.0), "b": (0, None, None, None, None)}


def test_series_overlap_and_union(spark):
    bars = candles.as_series(noise(spark, 6, symbols=("aa",)), "15m").withColumn("closed_at", F.col("opened_at") + F.make_dt_interval(mins=F.when(F.col("bar_index") == 2, 600).otherwise(15)))
    assert [r.bar_index for r in candles.overlaps(bars).collect()] == [3]
    other = candles.as_series(noise(spark, 4, symbols=("bb",)), "15m")
    plain = candles.as_series(noise(spark, 6, symbols=("aa",)), "15m")
    both = candles.union_series(plain, other)
    assert both.columns == plain.columns and both.count() == 10
    with pytest.raises(ValueError, match="given twice"):
        candles.union_series(plain, other, plain.limit(1))


def test_records_are_read_back_as_they_were(spark, tmp_path):
    bars = candles.as_series(noise(spark, 30), "15m")
    candles.write_records(bars, f"{tmp_path}/records", "json")
    got = spark.read.json(f"{tmp_path}/records")
    want = {(r.symbol, r.opened_at.strftime("%Y-%m-%dT%H:%M:%S.000Z"), *(f"{r[k]:f}" for k in ("open", "high", "low", "close", "volume"))) for r in bars.collect()}
    assert {(r.symbol, *(json.loads(r.record)[k] for k in ("timestamp", "open", "high", "low", "close", "volume"))) for r in got.collect()} == want
    assert {(r.timeframe, len(str(r.date))) for r in got.collect()} == {("15m", 10)}


def test_signals_are_of_one_series(spark):
    rows = spark.createDataFrame([("s1", "a"), ("s1", "a"), ("s2", "a"), ("s2", "b")], "signal_id string, series_key string")
    assert [tuple(r) for r in R.duplicated_signals(rows).collect()] == [("s2", 2)]


def test_quality_of_evidence(spark):
    df = spark.createDataFrame([(True, True, 30), (True, True, 29), (False, True, 99), (True, False, 99)], "base boolean, complete boolean, n int")
    got = [r[0] for r in df.select(R.evidence_quality(F.col("base"), F.col("complete"), F.col("n"), 30)).collect()]
    assert got == ["SUFFICIENT", "INSUFFICIENT_SAMPLE", "INCOMPLETE", "INCOMPLETE"]


def test_scalars_are_compared_but_never_conclusive(spark):
    schema = "symbol string, windows long, comparable long, mean_win_rate_change double, mean_avg_return_change double"
    base, cand = (R.scalars(spark.createDataFrame(rows, schema), "degradation", "symbol", "comparable") for rows in ([("a", 9, 99, 0.5, None), ("b", 3, 0, None, None)], [("a", 9, 50, 0.25, 1.0)]))
    got = {(r.group, r.metric): (r.base, r.cand, r.difference, r.base_sample, r.cand_sample, r.conclusive) for r in R.compare(base, cand, Config()).collect()}
    assert got["a", "mean_win_rate_change"] == (0.5, 0.25, -0.25, 99, 50, False)
    assert got["a", "mean_avg_return_change"] == (None, 1.0, None, 99, 50, False)
    assert got["b", "windows"] == (3.0, None, None, 0, 0, False)
    assert len(got) == 6


def test_ledger_keeps_conflicts_apart(spark):
    schema = "signal_id string, month string, outcome string, final_return double, mfe_return double, mae_return double"
    seen = [("s1", "m", "OPEN", None, None, None), ("s1", "m", "WIN", 0.1, 0.2, -0.1), ("s1", "m", "WIN", 0.1, 0.2, -0.1), ("s2", "m", "WIN", 0.1, 0.2, 0.0), ("s2", "m", "LOSS", -0.1, 0.2, -0.3), ("s3", "n", "OPEN", None, None, None)]
    rows, conflicts = R.ledger(spark.createDataFrame(seen, schema))
    assert sorted((r.signal_id, r.outcome, r.final_return) for r in rows.collect()) == [("s1", "WIN", 0.1), ("s3", "OPEN", None)]
    assert [tuple(r) for r in conflicts.collect()] == [("s2", 2)]
    stats = {r.month: (r.total, r.finalized) for r in R.ledger_stats(rows).collect()}
    assert stats == {"m": (1, 1), "n": (1, 0), None: (2, 1)}
