"""Bars of higher timeframes from lower ones, and tables that queries read once."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.plans import facts as P
from barloom.plans import queries
from barloom.sources import candles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("rolled"))
    start = dt.datetime(1995, 2, 26)
    lines = [(i, i % 3, i % 5, start + dt.timedelta(days=(i * 7919) % 160), None if i % 41 == 0 else float((i * 37) % 101), float(i % 9 + 1)) for i in range(3000)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(i, f"Brand#{i % 3 + 1}1") for i in range(4)], "p_partkey long, p_brand string").write.parquet(f"{folder}/part.parquet")
    return folder


def test_rolled_bars_are_those_of_the_events(spark, folder):
    days, higher = P.with_higher(P.line_bars(spark, folder, "1d"), ("3d", "1w"))
    for tf, bars in {"1d": days, **higher}.items():
        want = P.line_bars(spark, folder, tf)
        assert bars.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(tuple, bars.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        candles.rolled(higher["3d"], "1w")
    assert candles.rolled(days.where(F.lit(False)), "1w").count() == 0


@pytest.mark.parametrize("query", [queries.findings, queries.cells])
def test_lines_are_read_once(spark, folder, query):
    assert not query(spark, folder, queries.DAILY).inputFiles()


def test_bars_of_lines_sort_no_lines(spark, folder, capsys):
    P.line_bars(spark, folder, "1d").explain()
    assert "SortAggregate" not in capsys.readouterr().out


def test_bars_from_moments_are_those_of_events(spark):
    start, far = dt.datetime(1995, 2, 26), 2**63 - 1
    keys = [(None, None), (None, 5), (-far - 1, None), (-far - 1, -(2**31)), (-far - 1, 2**31 - 1), (-5, 3), (-5, -3), (0, None), (0, 0), (1, -1), (1, 2**31 - 1), (2, -(2**31)), (far, -(2**31)), (far, 2**31 - 1)]
    rows = [("a" if k % 3 else None, start + dt.timedelta(hours=6 * (d % 7)), float(1 + (k * 31 + d * 17) % 97), first, then) for d in range(7) for k, (first, then) in enumerate(keys)]
    rows += [("a", None, 3.0, 1, 1), ("b", start, None, 1, 1), ("b", start, 0.0, 1, 1), ("c", start, 2.5, None, 7)]
    lines = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, first long, then int").repartition(5)
    given = (F.col("symbol"), F.col("ts"), F.col("price"), F.lit(1))
    for tf in ("6h", "1d", "1w"):
        want = candles.bars_from_events(lines, tf, *given, [F.col("first"), F.col("then")])
        got = candles.bars_from_moments(lines, tf, *given, candles.in_order("first", "then"))
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    numbers = lines.select("first", "then", candles.in_order("first", "then").alias("n")).distinct()
    assert [(r[0], r[1]) for r in numbers.orderBy("n").collect()] == sorted({r[3:] for r in rows}, key=lambda k: tuple((x is not None, x or 0) for x in k))
